"""Collocations: frequent phrases of 2 to 4 words by sorting suffix pointers.

A suffix of a text starts at a word; a phrase is the beginning of a suffix that does not
leave its piece (a stretch between punctuation). Suffixes are routed to tasks by their two
leading words, and a task sorts the pointers of its suffixes by multikey three-way quicksort:
a part is split by its pivot word into smaller, equal and larger; the equal part is one more
word of a common phrase, its size is the phrase's count, and it is sorted on by the next word
down to four. A part that holds fewer suffixes than the least count is abandoned unsorted,
since none of its phrases can be frequent. Parts too small to be worth splitting further by
pivots are ordered at once.

Before they are routed, suffixes are cut and put together. A word that is itself rarer than
the least count ends a suffix; tasks know such words from a bitmap of fixed size (2**26 bits of
word hashes, 8 MB, whatever the corpus), in which a clash only keeps a word too many. Equal
suffixes of a task are counted once, and the suffixes of one route travel as one compressed
block: the block's words, each once, and columns of word numbers.

A pair of words that leads a large share of all suffixes would be one task. Such pairs (at most
a few thousand, each leading at least one in ``1 / HOT_SHARE`` suffixes of some task's stretch) are routed by all
four words instead; the tasks then hand on what they counted for the pair and its
continuations, without a threshold, and a grouped sum completes them. All counts pass that sum,
so nothing depends on which pairs were taken for hot.

Scores, overlaps and ranks are DataFrame joins over the frequent phrases. Products and
quotients are decimals of 38 digits.

Defined cases: a null text is empty, a null language is ``und``; A-Z only are lower-cased; pieces
end at ``.,;:!?`` and U+000A to U+000D, words at blanks and tabs, and any other code point,
other white space included, is part of a word; repeated rows count again; an empty table, or
one without frequent phrases, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogon.llm.common import drop_stage, write_stage

MAX_WORDS = 4
BITS = 26
HOT_SHARE = 1 / 500
_BLOCK_BITS = 32768  # of Spark's bitmap aggregates

#: A-Z to a-z, ends of a piece to a full stop, tab to blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)
)
_STOP = b"."


class Words(dict):
    """Word -> number in order of appearance; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_STOP: 0})

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def numbered(text: str | None, words: Words) -> list[int]:
    """Numbers of the words of a text, with a 0 between pieces."""
    if not text:
        return []
    folded = text.encode("utf-8", "replace").translate(_FOLD).replace(_STOP, b" . ")
    return list(map(words.__getitem__, filter(None, folded.split(b" "))))


def stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Words, np.ndarray]]:
    """(lang, words, numbers) of about ``size`` words of one language at a time, a longer text
    whole; numbers end with as many 0 as a phrase is long."""
    held: dict[str, tuple[Words, list[np.ndarray]]] = {}
    counts: dict[str, int] = {}

    def closed(lang):
        words, parts = held.pop(lang)
        counts.pop(lang)
        return lang, words, np.concatenate([*parts, np.zeros(MAX_WORDS, "int32")])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, parts = held.setdefault(lang, (Words(), []))
            numbers = numbered(text, words)
            if not numbers:
                continue
            parts.append(np.array([*numbers, 0], "int32"))
            counts[lang] = counts.get(lang, 0) + len(numbers)
            if sum(counts.values()) >= size:
                yield closed(max(counts, key=counts.get))
    for lang in [x for x in held if held[x][1]]:
        yield closed(lang)


def _texts(words: Words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def _counter(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, a, b, n): words with an empty b, and the pairs that lead many suffixes."""
        for lang, words, numbers in stretches(batches, size):
            texts = _texts(words)
            n = np.bincount(numbers, minlength=len(words))
            seen = np.flatnonzero(n[1:]) + 1
            both = (numbers[:-1] > 0) & (numbers[1:] > 0)
            keys, m = np.unique((numbers[:-1].astype("int64") << 32 | numbers[1:])[both], return_counts=True)
            hot = m >= max(1.0, HOT_SHARE * len(numbers))
            keys, m = keys[hot], m[hot]
            a = np.concatenate([seen, keys >> 32])
            b = np.concatenate([np.zeros(len(seen), "int64"), keys & 0xFFFFFFFF])
            second = pa.array([None if x == 0 else x for x in b.tolist()], pa.int64())
            yield pa.record_batch(
                [pa.array([lang] * len(a), pa.string()), texts.take(pa.array(a)), texts.take(second).fill_null(""),
                 pa.array(np.concatenate([n[seen], m]), pa.int64())],
                names=["lang", "a", "b", "n"],
            )

    return count


def _word_hash(lang: str, word: bytes) -> int:
    """Spark's xxhash64 of the two strings."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of (lang, a), put together in Spark; its size is fixed by ``BITS``."""
    bit = F.xxhash64("lang", "a").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = words.select(F.shiftright(bit, 15).alias("block"), bit.bitwiseAND(F.lit(_BLOCK_BITS - 1)).alias("bit"))
    found = rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(((1 << BITS) // _BLOCK_BITS, _BLOCK_BITS // 8), "uint8")
    for row in found:  # at most 2048 rows of 4 KB
        out[row["block"]] = np.frombuffer(row["bits"], "uint8")
    return out.ravel()


def suffixes(numbers: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more as rows of numbers, filled up with 0, and how
    often each occurs. A number that is not ``known`` ends a suffix like the end of a piece."""
    kept = np.where(known[numbers], numbers, 0)
    starts = np.flatnonzero((kept[:-1] > 0) & (kept[1:] > 0))
    starts = starts[starts <= len(kept) - MAX_WORDS]
    rows = np.empty((len(starts), MAX_WORDS), "int32")
    alive = np.ones(len(starts), bool)
    for i in range(MAX_WORDS):
        column = kept[starts + i]
        alive &= column > 0
        rows[:, i] = np.where(alive, column, 0)
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    if not len(rows):
        return rows, np.zeros(0, "int64")
    first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    at = np.flatnonzero(first)
    return rows[at], np.diff(np.concatenate([at, [len(rows)]]))


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


_BLOCKS = pa.schema([("route", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("words", pa.binary()), ("rows", pa.binary())])


def _router(size: int, routes: int, bits, hot):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, pairs = bits.value, hot.value
        for lang, words, numbers in stretches(batches, size):
            texts = list(words)
            hashes = np.array([_word_hash(lang, w) for w in texts], "uint64")
            low = hashes & np.uint64((1 << BITS) - 1)
            known = (bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype("uint8") & 1).astype(bool)
            known[0] = False
            rows, n = suffixes(numbers, known)
            if not len(rows):
                continue
            # Routed by two words, hot pairs by all four.
            key = (hashes[rows[:, 0]] * np.uint64(3)) ^ (hashes[rows[:, 1]] * np.uint64(5))
            scattered = np.array(
                sorted((words[a] << 32) + words[b] for a, b in pairs.get(lang, ()) if a in words and b in words), "int64"
            )
            is_hot = np.isin(rows[:, 0].astype("int64") << 32 | rows[:, 1], scattered)
            key = np.where(is_hot, key ^ (hashes[rows[:, 2]] * np.uint64(7)) ^ (hashes[rows[:, 3]] * np.uint64(11)), key)
            key ^= key >> np.uint64(29)
            to = (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(routes)
            order = np.argsort(to, kind="stable")
            to, rows, n = to[order], rows[order], n[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            made = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                used, local = np.unique(rows[lo:hi], return_inverse=True)
                if used[0] > 0:  # number 0 is the end in every block
                    used, local = np.concatenate([[0], used]), local + 1
                own = b" ".join(texts[i] for i in used[1:])
                local = local.reshape(hi - lo, MAX_WORDS).astype("uint32")
                packed = _pack([*np.ascontiguousarray(local.T), n[lo:hi].astype("uint32")])
                made.append((int(to[lo]), lang, hi - lo, zstandard.ZstdCompressor(level=1).compress(own), packed))
                if len(made) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _BLOCKS.types)], schema=_BLOCKS)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _BLOCKS.types)], schema=_BLOCKS)

    return route


def _unpack(n: int, words: bytes, rows: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    # Blocks carry their sizes in the frames.
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows), "uint32")
    own = zstandard.ZstdDecompressor().decompress(words).split(b" ")
    return own, data[: n * MAX_WORDS].reshape(MAX_WORDS, n).astype("int32"), data[n * MAX_WORDS :].astype("int64")


def multikey_quicksort(
    columns: list[np.ndarray], weights: np.ndarray, least: int, partial: dict[int, np.ndarray] | None = None, small: int = 4096
) -> Iterator[tuple[int, int, int]]:
    """(row, depth, count) of every common beginning: rows whose first ``depth`` columns equal
    those of ``row`` weigh ``count >= least``. 0 in a column ends a row.

    ``partial`` (first value -> second values) names pairs of which only some rows are here:
    the pair, its first value and its beginnings of three values are given whatever they weigh.

    Only pointers are moved. A part of more than ``small`` pointers is split three ways by a
    pivot; a smaller one is ordered at once, which gives the equal parts directly.
    """
    partial = partial or {}
    heads = np.array(sorted(partial), "int64")

    def exempt(row: int, depth: int):
        """Values of the next column that are given whatever they weigh; None for all of them."""
        if depth == 0:
            return heads
        seconds = partial.get(int(columns[0][row]), heads[:0]) if depth < 3 else heads[:0]
        if depth == 2:
            return None if columns[1][row] in seconds else heads[:0]
        return seconds

    pointers = np.arange(len(weights))
    parts = [(0, len(pointers), 0)] if len(pointers) else []
    while parts:
        lo, hi, depth = parts.pop()
        part = pointers[lo:hi]
        keys = columns[depth][part]
        free = exempt(int(part[0]), depth)
        sides = []
        if hi - lo > small:
            pivot = np.sort(keys[:: (hi - lo) // 64])[32]
            less, equal = keys < pivot, keys == pivot
            a, b = lo + int(less.sum()), lo + int(less.sum() + equal.sum())
            pointers[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
            sides = [(lo, a), (b, hi)]
            starts, ends, values = np.array([a]), np.array([b]), np.array([pivot])
        else:
            order = np.argsort(keys, kind="stable")
            pointers[lo:hi] = part[order]
            keys = keys[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            values, ends = keys[starts], np.concatenate([starts[1:], [hi - lo]]) + lo
            starts = starts + lo
        sums = np.concatenate([[0], np.cumsum(weights[pointers[lo:hi]])])
        counts = sums[ends - lo] - sums[starts - lo]
        kept = counts >= least
        if free is None:
            kept[:] = True
        elif len(free):
            kept |= np.isin(values, free)
        for x, y, count in zip(starts[kept & (values > 0)], ends[kept & (values > 0)], counts[kept & (values > 0)], strict=True):
            yield int(pointers[x]), depth + 1, int(count)
            if depth + 1 < len(columns):
                parts.append((int(x), int(y), depth + 1))
        for x, y in sides:
            if y > x and (free is None or len(free) or sums[y - lo] - sums[x - lo] >= least):
                parts.append((x, y, depth))


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _sorter(least: int, hot):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent beginnings of the suffixes of each route, a route at a time."""
        pairs = hot.value

        def blocks():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, own in groupby(blocks(), key=lambda b: (b[0], b[1])):
            words, columns, weights, lang = Words(), [], [], ""
            for _, lang, n, block_words, rows in own:
                texts, local, counts = _unpack(n, block_words, rows)
                numbers = np.array([0, *map(words.__getitem__, texts)], "int32")
                columns.append(numbers[local])
                weights.append(counts)
            columns, weights = np.concatenate(columns, axis=1), np.concatenate(weights)
            texts = list(words)
            # Of a pair that was dealt to all routes, only a part is here.
            partial: dict[int, list] = {}
            for first, second in pairs.get(lang, ()):
                if first in words and second in words:
                    partial.setdefault(words[first], []).append(words[second])
            made = []
            for row, depth, count in multikey_quicksort(
                list(columns), weights, least, {k: np.array(v) for k, v in partial.items()}
            ):
                if depth > 1:
                    made.append((lang, b" ".join(texts[columns[i][row]] for i in range(depth)).decode(), count))
                if len(made) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _PHRASES.types)], schema=_PHRASES)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _PHRASES.types)], schema=_PHRASES)

    return sort


def phrase_counts(docs: DataFrame, least: int = 30, size: int = 500_000, route_bytes: int = 4_000_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Counts of all words and frequent phrases per language of (lang, text).

    Returns (lang, n) with all word occurrences, (lang, phrase, f) for every phrase of one to
    four words with ``f >= least``, and the folders of what they read. ``size`` words are held in
    a task at a time, and a route takes about ``route_bytes`` of the corpus.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted_path = write_stage(
        texts.mapInArrow(_counter(size), "lang string, a string, b string, n long")
        .groupBy("lang", "a", "b").agg(F.sum("n").alias("n")),
        "collocation-words",
    )
    counted = spark.read.schema("lang string, a string, b string, n long").parquet(counted_path)
    words = counted.where("b = ''")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= least)
    total = {r["lang"]: r["n"] for r in totals.collect()}  # a row per language
    volume = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    routes = max(1, -(-volume // route_bytes))
    pairs: dict[str, set] = {}
    # A pair that leads so large a share is one of few: their counts add up to the words at most.
    large = reduce(lambda a, b: a | b, [(F.col("lang") == k) & (F.col("n") >= HOT_SHARE * v) for k, v in total.items()], F.lit(False))
    for r in counted.where("b <> ''").where(large).collect():
        pairs.setdefault(r["lang"], set()).add((r["a"].encode(), r["b"].encode()))
    bits, hot = spark.sparkContext.broadcast(_bitmap(common)), spark.sparkContext.broadcast(pairs)
    blocks = texts.mapInArrow(_router(size, routes, bits, hot), "route int, lang string, n int, words binary, rows binary")
    dealt = blocks.repartitionById(routes, F.col("route")).sortWithinPartitions("route", "lang")
    found = dealt.mapInArrow(_sorter(least, hot), "lang string, phrase string, n long")
    phrases = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    path = write_stage(phrases, "collocation-phrases")
    kept = spark.read.schema("lang string, phrase string, f long").parquet(path)
    every = kept.unionByName(common.select("lang", F.col("a").alias("phrase"), F.col("n").alias("f")))
    return totals, every, [counted_path, path]


def _exact(value) -> Column:
    return (F.lit(value) if isinstance(value, int) else F.col(value)).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, keep: int = 2000) -> DataFrame:
    """The best ``keep`` collocations per language of (lang, text): lang, rank, phrase, a, l, r,
    n, score.

    A candidate occurs ``a >= least`` times. Cut after its first k words it scores
    ``2000000 * a div (l + r)`` with the counts of both sides; its worst cut counts. Candidates
    that lie inside a longer one with at least 0.8 times their count go. The folders that the
    result reads stay in the shared staging folder.
    """
    totals, every, _ = phrase_counts(docs, least)
    words = F.split("phrase", " ")
    candidates = every.withColumn("size", F.size(words)).where("size > 1").withColumnRenamed("f", "a")

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    ks = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "size", ks).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    left = every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.call_function("div", _exact("a") * _exact(2_000_000), _exact("l") + _exact("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = [
        F.struct(part(F.lit(i), F.lit(m)).alias("phrase"), F.lit(i + m - 1).alias("upto"), F.lit(m).alias("m"))
        for m in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - m + 2)
    ]
    longer = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.filter(F.array(*inside), lambda x: (x["upto"] <= F.col("size")) & (x["m"] < F.col("size")))).alias("x")
    ).groupBy("lang", F.col("x.phrase").alias("phrase")).agg(F.max("a").alias("longest"))
    free = worst.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (_exact("longest") * _exact(100) < _exact("a") * _exact(80))
    )
    rank = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    )
    best = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank.cast("long"))
    return best.where(F.col("rank") <= keep).join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
),
phrases AS (
  SELECT lang, k::INT AS size, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM words, range(1, 5) a(k), range(1, len(w) - k + 2) b(i)
),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM phrases WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, size, w, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN (SELECT lang, phrase, f FROM counts) l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN (SELECT lang, phrase, f FROM counts) r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
),
worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM cand, range(2, 4) x(m), range(1, 4) y(i) WHERE m < size AND i + m - 1 <= size GROUP BY 1, 2
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank,
  w.phrase, a, l, r, n, score::BIGINT AS score
FROM worst w JOIN totals t ON t.lang = w.lang LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
WHERE longest IS NULL OR 100 * longest::HUGEINT < 80 * a::HUGEINT
QUALIFY rank <= 2000
"""
