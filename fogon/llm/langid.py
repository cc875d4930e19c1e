"""Language identification by interpolated Kneser-Ney character models.

Training. Every labelled training text counts: its words (lower-cased runs that hold a
letter) are padded, and their character ``ORDER``-grams are counted per language, summed per
task before they are shuffled. Lower orders follow from the distinct n-grams (continuation
counts), as Kneser-Ney smoothing asks. Discounts, probabilities and back-off weights are
computed over all n-grams of all languages, none is left out.

Model. Per order one sorted array of n-gram hashes with, per language, the interpolated
probability and (below the last order) the back-off weight of the n-gram as a context, as
32-bit floats; a look-up is a bisection. It grows with the distinct n-grams and reaches the
driver in ranges of the hash.

Prediction. The language of lowest cross-entropy per character wins. ``score`` is its
posterior over the languages at the evidence of the square root of the text's length.
Rejection is calibrated on all training texts: per language and length class (powers of two of
the letters), the 99.5 % quantile of the cross-entropy plus ``slack`` nats (of a class beyond
10,000 texts, a value whose rank is off by at most one in 10,000). :func:`label` scores every
text once and takes the limits from the written scores of the training texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected;
rows with a null language are not learned from; without any training row all texts are
``und``; ties go to the language that sorts first; long texts are processed whole, and each
distinct word is looked up once per batch and kept in a bounded table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogon.llm.common import docs_of, drop_stage, give_back, word_bytes, write_stage
from fogon.operators.staging import stage

ORDER = 4
_START, _END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words a task counts before it hands on their n-grams, and words whose scores it keeps.
_HELD, _KEPT = 100_000, 150_000
#: Rows of the model that reach the driver at once.
_RANGE_ROWS = 8_000_000


def _letters(word: bytes) -> str | None:
    """A word as lower-case text, None if it has no letter."""
    text = word.decode("utf-8", "replace").lower()
    return text if any(map(str.isalpha, text)) else None


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words in one array, and the place of each predicted one."""
    joined = "".join(_START * (ORDER - 1) + w + _END for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
    sizes = np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)[:-1])) + ORDER - 1
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return codes, at


def _hashes(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place."""
    out = np.full(len(at), n, dtype="uint64")
    for i in range(n - 1, -1, -1):
        out = (out ^ codes[at - i]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def _count_ngrams(words: Counter) -> tuple[list[str], np.ndarray]:
    """Distinct ORDER-grams of the words with their counts."""
    clean: Counter = Counter()
    for w, n in words.items():
        text = _letters(w)
        if text:
            clean[text] += n
    if not clean:
        return [], np.empty(0, "int64")
    texts = list(clean)
    codes, at = _codes(texts)
    weight = np.repeat(
        np.fromiter(clean.values(), dtype="int64", count=len(texts)),
        np.fromiter(map(len, texts), dtype="int64", count=len(texts)) + 1,
    )
    # Order four times 16 bits: characters are numbered within this call.
    alphabet, small = np.unique(codes, return_inverse=True)
    if len(alphabet) >= 1 << 16:  # more characters than numbers: count the halves
        a, b = Counter(dict(list(words.items())[::2])), Counter(dict(list(words.items())[1::2]))
        (ka, ca), (kb, cb) = _count_ngrams(a), _count_ngrams(b)
        return ka + kb, np.concatenate((ca, cb))
    key = np.zeros(len(at), dtype="uint64")
    for i in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(16)) | small[at - i].astype("uint64")
    keys, inverse = np.unique(key, return_inverse=True)
    counts = np.bincount(inverse, weights=weight).astype("int64")
    parts = np.stack([(keys >> np.uint64(16 * (ORDER - 1 - i))) & np.uint64(0xFFFF) for i in range(ORDER)], axis=1)
    flat = alphabet[parts.astype("int64")].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)], counts


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the texts of (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])

    def work(batches):
        held: dict[str, Counter] = {}

        def flush(lang):
            grams, counts = _count_ngrams(held.pop(lang))
            raw = [g.encode("utf-8", "surrogatepass") for g in grams]
            for i in range(0, len(raw), 20_000):
                part = raw[i : i + 20_000]
                yield pa.record_batch(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(counts[i : i + 20_000])],
                    schema=schema,
                )

        for lang, text in docs_of(batches):
            held.setdefault(lang, Counter()).update(word_bytes(text))
            if sum(map(len, held.values())) > _HELD:
                for full in list(held):
                    yield from flush(full)
        for lang in list(held):
            yield from flush(lang)

    # Two bytes long keys and a sum: combined per task again before the shuffle.
    rows = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    return rows.mapInArrow(work, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Sorted hash arrays per order; columns are languages."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    prob: list[np.ndarray] = field(default_factory=list)  # NaN: n-gram unseen in a language
    back: list[np.ndarray] = field(default_factory=list)  # 1: context unseen; empty for the last order
    unknown: np.ndarray = field(default_factory=lambda: np.empty(0))
    limits: dict[tuple[int, int], float] = field(default_factory=dict)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities of each word's characters, per language."""
        codes, at = _codes(words)
        p = np.broadcast_to(self.unknown, (len(at), len(self.languages))).copy()
        back = None
        for n in range(1, ORDER + 1):
            h = _hashes(codes, at, n)
            i = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][i] == h
            if n > 1:
                p *= back
            found = self.prob[n - 1][i]
            p = np.where(hit[:, None] & ~np.isnan(found), found, p)
            if n < ORDER:
                # Weight of the context of the next order: the n-gram that ends one before.
                c = _hashes(codes, at - 1, n)
                j = np.minimum(np.searchsorted(self.keys[n - 1], c), len(self.keys[n - 1]) - 1)
                back = np.where((self.keys[n - 1][j] == c)[:, None], self.back[n - 1][j], 1.0)
        logs = np.log(p)
        sizes = np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1
        return np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes)[:-1])))

    def limit(self, lang: int, letters: int) -> float:
        """Largest cross-entropy that is not rejected."""
        k = int(letters).bit_length()
        known = [b for (la, b) in self.limits if la == lang]
        if not known:
            return np.inf
        return self.limits[lang, min(known, key=lambda b: (abs(b - k), b))]


def _discounts(levels: list[DataFrame]) -> dict[tuple[int, str], tuple[float, int, int]]:
    """(order, language): discount from all counts of one and two, sum and number of n-grams."""
    per = [
        x.groupBy("lang").agg(
            F.lit(n).alias("order"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"),
            F.sum("n").alias("total"), F.count("*").alias("kinds"),
        )
        for n, x in enumerate(levels, 1)
    ]
    out = {}
    for r in reduce(DataFrame.unionByName, per).collect():
        seen = r.n1 + 2 * r.n2
        out[r.order, r.lang] = (min(0.9, max(0.1, r.n1 / seen)) if seen else 0.5, r.total, r.kinds)
    return out


def _hash_of(n: int):
    """UDF: hash of an n-gram of ``n`` characters, as a signed number."""

    def of(gram: pd.Series) -> pd.Series:
        codes = np.frombuffer("".join(gram).encode("utf-32-le"), "<u4").astype("uint64")
        return pd.Series(_hashes(codes, np.arange(n - 1, len(codes), n), n).view("int64"))

    return F.pandas_udf(of, "long")


def _model_rows(levels: list[DataFrame], small: list[DataFrame], alphabet: int) -> DataFrame:
    """(order, h, col, prob, back) of every n-gram (prob) and every context (back)."""
    out = []
    values = None
    for n, level in enumerate(levels, 1):
        parts = level.join(F.broadcast(small[n - 1]), "lang")
        if n == 1:
            share, weight = (F.col("n") - F.col("d")) / F.col("total"), F.col("d") * F.col("kinds") / F.col("total")
            values = parts.select("lang", "col", "gram", (share + weight / alphabet).alias("value"))
        else:
            parts = parts.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
            # A context has at most one row per character of the alphabet.
            by = Window.partitionBy("lang", "context")
            total, kinds = F.sum("n").over(by), F.count("*").over(by)
            parts = parts.select(
                "lang", "col", "gram", "context", F.expr("substring(gram, 2)").alias("shorter"),
                ((F.col("n") - F.col("d")) / total).alias("share"), (F.col("d") * kinds / total).alias("weight"),
            )
            contexts = parts.groupBy("lang", "context").agg(F.first("col").alias("col"), F.first("weight").alias("weight"))
            out.append(contexts.select(
                F.lit(n - 1).alias("order"), _hash_of(n - 1)("context").alias("h"), "col",
                F.lit(None).cast("float").alias("prob"), F.col("weight").cast("float").alias("back"),
            ))
            below = values.select("lang", F.col("gram").alias("shorter"), F.col("value").alias("below"))
            values = parts.join(below, ["lang", "shorter"]).select(
                "lang", "col", "gram", (F.col("share") + F.col("weight") * F.col("below")).alias("value")
            )
        out.append(values.select(
            F.lit(n).alias("order"), _hash_of(n)("gram").alias("h"), "col",
            F.col("value").cast("float").alias("prob"), F.lit(None).cast("float").alias("back"),
        ))
    return reduce(DataFrame.unionByName, out)


def _gather(model: CharModel, table: DataFrame) -> None:
    """Fill the arrays from (order, h, col, prob, back), one range of hashes at a time."""
    bits = (-(-table.count() // _RANGE_ROWS) - 1).bit_length()
    pieces: list[list[tuple]] = [[] for _ in range(ORDER)]
    for r in range(1 << bits):
        # Ranges by the leading bits, so that pieces follow each other in the order of the keys.
        part = table.where(F.shiftrightunsigned("h", 64 - bits) == r) if bits else table
        rows = part.toArrow()
        order, h, col = (rows[c].to_numpy() for c in ("order", "h", "col"))
        prob, back = (rows[c].to_numpy() for c in ("prob", "back"))  # null: NaN
        for n in range(1, ORDER + 1):
            own = np.flatnonzero(order == n)
            keys, at = np.unique(h[own].view("uint64"), return_inverse=True)
            shape = (len(keys), len(model.languages))
            p, w = np.full(shape, np.nan, "float32"), np.ones(shape if n < ORDER else (0, shape[1]), "float32")
            some = ~np.isnan(prob[own])
            p[at[some], col[own][some]] = prob[own][some]
            w[at[~some], col[own][~some]] = back[own][~some]
            pieces[n - 1].append((keys, p, w))
    for parts in pieces:
        for held, arrays in zip((model.keys, model.prob, model.back), zip(*parts, strict=True), strict=True):
            held.append(arrays[0] if len(arrays) == 1 else np.concatenate(arrays))


def fit(docs: DataFrame, slack: float = 2.0) -> CharModel:
    """Model from (lang, text), with limits of rejection from all of its texts."""
    model = _train(docs)
    if model.languages:
        rows = docs.where(F.col("lang").isNotNull())
        _calibrate(model, rows.select("lang", identify(model, F.col("text")).alias("r")), slack)
    return model


def label(docs: DataFrame, training: Column, keep: list[str], into: str, slack: float = 2.0) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the struct ``into`` of :func:`identify` under the model of
    the rows that ``training`` marks. Each text is scored once; the scores are written."""
    model = _train(docs.where(training))
    known = F.when(training, F.col("lang")).alias("known")
    scored = stage(
        docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(known, identify(model, F.col("text")).alias("r")).alias(into)),
        "languages",
    )
    if model.languages:
        _calibrate(model, scored.where(F.col(f"{into}.known").isNotNull()).select(F.col(f"{into}.known").alias("lang"), f"{into}.r"), slack)
    return scored.withColumn(into, F.col(f"{into}.r").withField("rejected", _rejected(model, F.col(f"{into}.r"))))


def _train(docs: DataFrame) -> CharModel:
    """Model from (lang, text), without limits."""
    spark = docs.sparkSession
    counted = write_stage(ngram_counts(docs).withColumn("gram", F.col("gram").cast("string")), "ngrams")
    levels = [spark.read.schema("lang string, gram string, n long").parquet(counted)]
    for _ in range(ORDER - 1):  # continuation counts: distinct left neighbours
        shorter = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
        levels.insert(0, shorter.agg(F.count("*").alias("n")))
    discounts = _discounts(levels)
    model = CharModel(sorted({lang for _, lang in discounts}))
    if model.languages:
        alphabet = levels[0].select("gram").distinct().count() + 1
        pieces = [discounts[1, lang] for lang in model.languages]
        model.unknown = np.array([d * kinds / total / alphabet for d, total, kinds in pieces])
        small = [
            spark.createDataFrame(
                [(lang, i, *discounts[n, lang]) for i, lang in enumerate(model.languages)],
                "lang string, col int, d double, total long, kinds long",
            )
            for n in range(1, ORDER + 1)
        ]
        tables = write_stage(_model_rows(levels, small, alphabet), "langid")
        _gather(model, spark.read.schema("order int, h long, col int, prob float, back float").parquet(tables))
        drop_stage(tables)
    drop_stage(counted)
    return model


def _calibrate(model: CharModel, scored: DataFrame, slack: float) -> None:
    """Set the limits of rejection from (lang, r), ``r`` as of :func:`identify`, of the training texts."""
    # No filter on the result: Spark would push it below and run the model twice.
    right = F.when(F.col("r.lang_pred") == F.col("lang"), F.col("r.entropy"))
    by = scored.groupBy("lang", F.ceil(F.log2(F.col("r.letters") + 1)).cast("int").alias("size"))
    quantiles = by.agg(F.percentile_approx(right, 0.995).alias("q")).where("q IS NOT NULL")
    for r in quantiles.collect():
        model.limits[model.languages.index(r.lang), r["size"]] = r.q + slack


def _rejected(model: CharModel, r: Column) -> Column:
    """Whether a scored text is beyond its limit, as the model says; without a letter it is."""
    if not model.limits:
        return r["entropy"].isNull()
    sizes = [k for _, k in model.limits]
    low, high = min(sizes), max(sizes)
    limits = F.create_map(*[
        part for i, lang in enumerate(model.languages)
        for part in (F.lit(lang), F.array(*[F.lit(float(model.limit(i, (1 << k) - 1))) for k in range(low, high + 1)]))
    ])
    size = F.least(F.greatest(F.length(F.bin(r["letters"])), F.lit(low)), F.lit(high))
    return F.coalesce(r["entropy"] > F.get(limits[r["lang_pred"]], size - low), F.lit(True))


class _Scorer:
    """Words of a worker with their log probabilities, in a table of bounded size."""

    def __init__(self, model: CharModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        # Columns: log probability per language, predicted characters, letters.
        self.table = np.zeros((0, len(self.model.languages) + 2))

    def learn(self, new: list[bytes]) -> None:
        texts = [_letters(w) for w in new]
        some = [i for i, t in enumerate(texts) if t]
        rows = np.zeros((len(new), self.table.shape[1]))
        if some and self.model.languages:
            words = [texts[i] for i in some]
            rows[some, :-2] = self.model.log_probs(words)
            rows[some, -2] = np.fromiter(map(len, words), dtype="int64") + 1
            rows[some, -1] = rows[some, -2] - 1
        base = len(self.place)
        self.place.update(zip(new, range(base, base + len(new)), strict=True))
        self.table = np.concatenate((self.table, rows))

    def score(self, texts: list[str | None]) -> list[tuple]:
        cut = [word_bytes(t) for t in texts]
        if len(self.place) > _KEPT:
            self.clear()
        new = {w for words in cut for w in words}.difference(self.place)
        if new:
            self.learn(list(new))
        get = self.place.__getitem__
        return [self._one(np.fromiter(map(get, words), dtype="int64", count=len(words))) for words in cut]

    def _one(self, at: np.ndarray) -> tuple:
        model = self.model
        sums = self.table[at].sum(axis=0) if len(at) else np.zeros(self.table.shape[1])
        letters = int(sums[-1])
        if not letters or not model.languages:
            return "und", 0.0, None, letters, True
        entropy = -sums[:-2] / sums[-2]
        best = int(np.argmin(entropy))
        share = np.exp(-(entropy - entropy[best]) * np.sqrt(letters))
        return (
            model.languages[best], float(1 / share.sum()), float(entropy[best]), letters,
            bool(entropy[best] > model.limit(best, letters)),
        )


_RESULT = "lang_pred string, score double, entropy double, letters long, rejected boolean"


def identify(model: CharModel, text: Column) -> Column:
    """struct<lang_pred, score, entropy, letters, rejected> of a text column."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    def work(parts):
        scorer = _Scorer(shared.value)
        for texts in parts:
            rows = []
            for i in range(0, len(texts), 200):
                rows += scorer.score(list(texts.iloc[i : i + 200]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "entropy", "letters", "rejected"])
        del scorer
        give_back()

    from collections.abc import Iterator

    work.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(work, _RESULT)(text)
