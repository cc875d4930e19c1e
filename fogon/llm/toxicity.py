"""Toxicity by maximum-scoring segments of token log-odds.

Weights. Counts of the texts with a word, toxic and other, give log-odds with an informative
Dirichlet prior (the counts of both classes, scaled to ``prior``, plus a half). Words whose
log-odds exceed ``z_least`` standard errors carry their log-odds; every other word carries
``log(1 - share)``, the price of a plain word in a passage of which ``share`` are marked.

Passages. A linear scan (Ruzzo and Tompa) finds all maximal segments of positive score. By
extreme-value theory a segment of score S in a text of n words is matched by chance
``E = K n exp(-lambda S)`` times; lambda solves sum p(w) exp(lambda s(w)) = 1 over the words of
the texts that are not toxic, and K is the rate of their segments at a fixed score. Segments
with E below ``e_most`` are significant; a text's evidence is the sum of their -ln E.

Score. A logistic curve through (evidence, label) of the training texts turns evidence into
the probability of label 1, so 0.3 means 0.3. The evidence of each fold of those texts comes
from weights of the other folds; where some fold leaves nothing to learn from, from all texts.

Training takes all labelled texts of the training folds. They meet their labels once and are
written; every pass of the fit reads them from there. Their words are counted once, per class and
fold, and written; every model adds up the folds it learns from.

Defined cases: a null or word-free text has no passage and gets the score of no evidence;
null labels are not learned from; of repeated labels the largest counts; without both
classes all texts score the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.llm.common import docs_of, drop_stage, settings, word_bytes, write_stage

_RATE_SCORE = 1.0
#: Words a task counts before it hands on what it has.
_HELD = 100_000
_NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@dataclass
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    plain: float = -0.1
    lam: float = 1.0
    rate: float = 1e-4
    e_most: float = 0.5
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, score) of all maximal segments."""
        if self.weights.keys().isdisjoint(words):
            return []
        get = self.weights.get
        marked = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        # Ruzzo-Tompa: candidates keep (first, end, sum before, sum through).
        found: list[list] = []
        total, last = 0.0, -1
        for i, s in marked:
            total += self.plain * (i - last - 1)
            last = i
            new = [i, i + 1, total, total + s]
            total += s
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j -= 1
                if j < 0 or found[j][3] >= new[3]:
                    found.append(new)
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
        return [(a, b, right - left) for a, b, left, right in found]

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float, float]]:
        """Significant segments with their E-value."""
        n = len(words)
        out = []
        for a, b, s in self.segments(words):
            e = self.rate * n * float(np.exp(-self.lam * s))
            if e < self.e_most:
                out.append((a, b, s, e))
        return out

    def evidence(self, passages) -> float:
        return float(sum(-np.log(max(e, 1e-300)) for *_, e in passages))

    def score(self, evidence: float) -> float:
        if not any(self.curve):
            return self.base
        x = np.dot(self.curve, (1.0, evidence > 0, np.log1p(evidence)))
        return float(1 / (1 + np.exp(-x)))


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column, max_labels: int | None = None) -> DataFrame:
    """(text, toxic) of all labelled training texts; with ``max_labels``, of at most so many, chosen
    by a hash of the id. Whether the labels are broadcast is left to Spark's size check."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    if max_labels is not None:
        width = 1 << 24
        share = min(1.0, 0.95 * max_labels / max(1, known.count()))
        if share < 1:
            known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(width)) < int(share * width))
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _word_counts(rows: DataFrame, folds: int) -> DataFrame:
    """Texts with a word per class and fold, summed per task first: (word, t0, o0, t1, o1, ...), t the
    toxic ones. One pass and one shuffle serve the model of all texts and those of all folds."""
    schema = pa.schema([("word", pa.binary()), ("k", pa.int32()), ("n", pa.int64())])

    def work(batches):
        counts: dict[int, Counter] = {}

        def flush():
            for k, own in counts.items():
                items = iter(own.items())
                while part := list(islice(items, 10_000)):
                    words, n = zip(*part, strict=True)
                    columns = [pa.array(words, pa.binary()), pa.array([k] * len(n), pa.int32()), pa.array(n, pa.int64())]
                    yield pa.record_batch(columns, schema=schema)
            counts.clear()

        for text, toxic, own in docs_of(batches):
            # A word counts once per text, so a text that repeats itself is one witness.
            counts.setdefault(2 * own + (toxic != 1), Counter()).update(set(word_bytes(text)))
            if sum(map(len, counts.values())) > _HELD:
                yield from flush()
        yield from flush()

    cells = [
        F.coalesce(F.sum(F.when(F.col("k") == 2 * i + j, F.col("n"))), F.lit(0)).alias(f"{c}{i}")
        for i in range(folds) for j, c in enumerate("to")
    ]
    return rows.select("text", "toxic", "own").mapInArrow(work, "word binary, k int, n long").groupBy("word").agg(*cells)


def _weigh(
    rows: DataFrame, counts: DataFrame, kept: list[int], prior: float, z_least: float, share: float, e_most: float
) -> ToxicityModel:
    """Model from (text, toxic, own) of the folds ``kept`` and their word counts, still without a curve;
    without weights where nothing can be learned."""
    model = ToxicityModel(plain=float(np.log(1 - share)), e_most=e_most)
    rows = rows.where(F.col("own").isin(kept))
    sizes = {r.is_toxic: r.n for r in rows.groupBy((F.col("toxic") == 1).alias("is_toxic")).agg(F.count("*").alias("n")).collect()}
    texts = sum(sizes.values())
    model.base = sizes.get(True, 0) / texts if texts else 0.0
    if len(sizes) < 2:
        return model
    counts = counts.select("word", *[sum((F.col(f"{c}{i}") for i in kept), F.lit(0)).alias(c) for c in "to"])
    counts = counts.where(F.col("t") + F.col("o") > 0)
    n_t, n_o = counts.agg(F.sum("t"), F.sum("o")).first()
    if not n_t or not n_o:
        return model
    # Half a text besides the corpus share keeps the variance of unseen words finite.
    alpha = (F.col("t") + F.col("o")) * (prior / (n_t + n_o)) + 0.5
    t, o = F.col("t") + alpha, F.col("o") + alpha
    delta = F.log(t / (n_t + prior - t)) - F.log(o / (n_o + prior - o))
    scored = counts.select("word", "t", "o", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / o)).alias("z"))
    strong = scored.where((F.col("z") >= z_least) & (F.col("delta") > 0)).orderBy(F.desc("z"), "word").collect()
    if not strong:
        return model
    model.weights = {bytes(r.word): float(r.delta) for r in strong}
    # Chance of each weight in the other texts, for lambda.
    p = np.array([(r.o + 0.5) / n_o for r in strong] + [0.0])
    p[-1] = max(1e-6, 1 - p.sum())
    s = np.array([r.delta for r in strong] + [model.plain])
    model.lam = _lambda(p, s)
    # Rate of segments in the texts that are not toxic: K = count(S >= x) / words * exp(lambda x).
    plain = rows.where("toxic <> 1").select(_rate(model)(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] or 0
    model.rate = (plain + 0.5) / n_o * float(np.exp(model.lam * _RATE_SCORE))
    return model


def fit(
    rows: DataFrame, prior: float = 1000.0, z_least: float = 4.0, share: float = 0.1, e_most: float = 0.5, folds: int = 3
) -> ToxicityModel:
    """Model from (text, toxic); the curve comes from texts that gave no weights (``folds``).

    The texts meet their labels in a shuffle at every size: the work of a small input is then that
    of a large one, and labels that grow past what fits a broadcast change nothing.
    """
    spark = rows.sparkSession
    # Copies of a text are in one fold.
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("own"))
    with settings(spark, _NO_BROADCAST):
        written = write_stage(rows, "labelled")
    rows = spark.read.schema(rows.schema).parquet(written)
    counts = _word_counts(rows, folds)
    counted = write_stage(counts, "words")
    model = _fit(rows, spark.read.schema(counts.schema).parquet(counted), prior, z_least, share, e_most, folds)
    drop_stage(written, counted)
    return model


def _fit(
    rows: DataFrame, counts: DataFrame, prior: float, z_least: float, share: float, e_most: float, folds: int
) -> ToxicityModel:
    every = list(range(folds))
    model = _weigh(rows, counts, every, prior, z_least, share, e_most)
    if not model.weights:
        return model
    models = [_weigh(rows, counts, [f for f in every if f != i], prior, z_least, share, e_most) for i in every]
    if all(m.weights for m in models):
        parts = [(m, rows.where(F.col("own") == i)) for i, m in enumerate(models)]
    else:
        parts = [(model, rows)]
    found = pd.concat(
        part.select(detect(m, F.col("text")).alias("r"), F.col("toxic")).groupBy(F.round("r.evidence", 2).alias("e"), "toxic")
        .agg(F.count("*").alias("n")).toPandas()
        for m, part in parts
    )
    model.curve = _logistic(found.e.to_numpy(), (found.toxic == 1).to_numpy(), found.n.to_numpy())
    return model


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection; a small one if the mean is not negative."""
    low, high = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 500))).sum()) - 1
    if f(low) >= 0:
        return 0.05
    while f(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _rate(model: ToxicityModel):
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(s >= _RATE_SCORE for *_, s in model.segments(word_bytes(t)))).astype("int64")

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, "long")


def _logistic(e: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression on (1, e > 0, log1p e) by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(e)), (e > 0).astype(float), np.log1p(e)], axis=1)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 1e-3 * beta
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


_RESULT = "score double, evidence double, n_words long, passages array<struct<first:int,last:int,score:double,e:double>>"


def detect(model: ToxicityModel, text: Column) -> Column:
    """struct<score, evidence, n_words, passages> of a text column; passages in words."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def work(parts):
        own = shared.value
        for texts in parts:
            rows = []
            for t in texts:
                words = word_bytes(t)
                passages = own.passages(words)
                evidence = own.evidence(passages)
                rows.append(
                    (own.score(evidence), evidence, len(words),
                     [{"first": a, "last": b - 1, "score": s, "e": e} for a, b, s, e in passages])
                )
            yield pd.DataFrame(rows, columns=["score", "evidence", "n_words", "passages"])

    work.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(work, _RESULT)(text)
