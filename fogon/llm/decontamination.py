"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is
one window. A document word inside any occurrence of a window is hit.

Method. A window's tokens are its shingles of ``SHINGLE`` words (of all its words if it has
fewer). All tokens of a window must occur in a text that contains it, so of its tokens,
ordered by rarity in the corpus, the first alone is a necessary prefix. Texts are joined
with these prefix tokens; a candidate must fit (length bound: a run of benchmark words at
least as long as the window; positional bound: the token's offset puts the window inside the
run) and is then compared word by word, which is exact whatever the hashes do.

Scale. The benchmark is the stated query set: its (item, window) rows are cut into blocks of
at most ``block_windows``, so each broadcast is bounded, and every block meets every text in
the same pass (blocks are chained columns; no shuffle of texts and no cross join). Rarity is
counted over all documents, summed per task before it is shuffled.

Defined cases: a null or word-free text has no words and no hit; word-free items have no
window; a null item id counts as the item with the empty id, repeated item ids as one item;
an empty benchmark hits nothing; documents keep all their rows, repeated or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.llm.common import docs_of, emit, word_bytes

SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIT = "n_words long, starts array<int>, ends array<int>, items array<string>"
_SUMMARY = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item, window) rows: the window's words joined by blanks, each once per item."""
    schema = pa.schema([("item", pa.string()), ("window", pa.binary())])

    def work(batches):
        def rows():
            for item, text in docs_of(batches):
                words = word_bytes(text)
                if words:
                    n = min(size, len(words))
                    for i in range(len(words) - n + 1):
                        yield item, b" ".join(words[i : i + n])

        yield from emit(rows(), schema)

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(work, "item string, window binary").distinct()


def shingle_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word numbers; none if there are fewer numbers."""
    n = max(0, len(ids) - k + 1)
    out = np.zeros(n, dtype="uint64")
    for i in range(k):
        out = (out ^ ids[i : i + n].astype("uint64")) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Block:
    """A bounded part of the windows with its word numbers and prefix tokens."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        texts = sorted({w for _, w in rows})
        number = {w: i for i, w in enumerate(texts)}
        self.items: list[list[str]] = [[] for _ in texts]
        for item, w in rows:
            self.items[number[w]].append(item)
        words = [w.split() for w in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({x for ws in words for x in ws}), 1)}
        self.words = [np.array([self.vocabulary[x] for x in ws], dtype="int64") for ws in words]
        self.shortest = min(map(len, self.words), default=0)
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sizes(self) -> list[int]:
        """Shingle sizes in use: SHINGLE, and the length of each shorter window."""
        return sorted({min(SHINGLE, len(w)) for w in self.words})

    def tokens(self) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset, shingle size, token) of every shingle."""
        for i, w in enumerate(self.words):
            k = min(SHINGLE, len(w))
            for offset, token in enumerate(shingle_ids(w, k).tolist()):
                yield i, offset, k, token

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep the rarest token of each window as its prefix."""
        rarest: dict[int, tuple] = {}
        for i, offset, k, token in self.tokens():
            rank = (counts.get((k, token), 0), token, offset, k)
            if i not in rarest or rank < rarest[i]:
                rarest[i] = rank
        for k in self.sizes():
            own = sorted((token, i, offset) for i, (_, token, offset, kk) in rarest.items() if kk == k)
            self.prefix[k] = (
                np.array([t for t, _, _ in own], dtype="uint64"),
                np.array([i for _, i, _ in own], dtype="int64"),
                np.array([o for _, _, o in own], dtype="int64"),
            )

    def runs(self, text: str | None) -> tuple[int, list[tuple[int, np.ndarray]]]:
        """Number of words; (position, word numbers) of runs long enough for a window."""
        words = word_bytes(text)
        if not words or not self.vocabulary:
            return len(words), []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype="int64", count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view("i1"), [0]))))
        return len(words), [(int(a), ids[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= self.shortest]

    def matches(self, text: str | None) -> tuple[int, list[int], list[int], set[int]]:
        """Number of words; starts and ends of occurrences; windows that occur."""
        n, runs = self.runs(text)
        starts, ends, found = [], [], set()
        for at, ids in runs:
            for k, (tokens, window, offset) in self.prefix.items():
                keys = shingle_ids(ids, k)
                lo = np.searchsorted(tokens, keys, side="left")
                hi = np.searchsorted(tokens, keys, side="right")
                for p in np.flatnonzero(hi > lo).tolist():
                    for j in range(int(lo[p]), int(hi[p])):
                        w = self.words[window[j]]
                        a = p - int(offset[j])
                        if a >= 0 and a + len(w) <= len(ids) and np.array_equal(ids[a : a + len(w)], w):
                            starts.append(at + a)
                            ends.append(at + a + len(w))
                            found.add(int(window[j]))
        return n, starts, ends, found


def _rarity(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences in the corpus of the block's tokens; at most one row per token comes back."""
    sizes = block.sizes()
    wanted = {k: np.unique(np.array([t for _, _, kk, t in block.tokens() if kk == k], dtype="uint64")) for k in sizes}
    shared = docs.sparkSession.sparkContext.broadcast((block, wanted))
    schema = pa.schema([("k", pa.int32()), ("token", pa.int64()), ("n", pa.int64())])

    def work(batches):
        own, tokens = shared.value
        counts = {k: np.zeros(len(t), dtype="int64") for k, t in tokens.items()}
        for (text,) in docs_of(batches):
            for _, ids in own.runs(text)[1]:
                for k, t in tokens.items():
                    keys = shingle_ids(ids, k)
                    at = np.minimum(np.searchsorted(t, keys), len(t) - 1)
                    np.add.at(counts[k], at[t[at] == keys], 1)
        for k, c in counts.items():
            some = np.flatnonzero(c)
            if len(some):
                yield pa.record_batch(
                    [pa.array(np.full(len(some), k, "int32")), pa.array(tokens[k][some].view("int64")), pa.array(c[some])],
                    schema=schema,
                )

    found = docs.select("text").mapInArrow(work, "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))
    out = {(r.k, r.token % 2**64): r.n for r in found.collect()}
    shared.unpersist()
    return out


class Decontaminator:
    """Windows of a benchmark, ready to be looked for in texts."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = 13, block_windows: int = 100_000):
        spark = docs.sparkSession
        all_windows = windows(items, size)
        n_blocks = max(1, -(-all_windows.count() // block_windows))
        self.blocks = []
        for b in range(n_blocks):
            part = all_windows.where(F.pmod(F.xxhash64("item", "window"), F.lit(n_blocks)) == b)
            block = Block([(r.item, bytes(r.window)) for r in part.collect()])
            block.order_by_rarity(_rarity(docs, block))
            self.blocks.append(spark.sparkContext.broadcast(block))

    def hits(self, text: Column) -> Column:
        """struct<n_words, n_hit, n_items, items_sha256, contaminated> of a text column."""
        found = None
        for i, block in enumerate(self.blocks):
            last = i == len(self.blocks) - 1
            before = [] if found is None else [found["starts"], found["ends"], found["items"]]
            found = _finder(block, last)(text, *before)
        return found


def _finder(block, last: bool):
    """UDF of (text, starts, ends, items found so far); the last one sums up, so a benchmark
    of one block costs one Python step."""

    def find(*columns: pd.Series) -> pd.DataFrame:
        own: Block = block.value
        rows = []
        for text, *before in zip(*columns, strict=True):
            n, starts, ends, found = own.matches(text)
            items = {i for w in found for i in own.items[w]}
            if before:
                starts, ends, items = [*before[0], *starts], [*before[1], *ends], items.union(before[2])
            rows.append(_summary(n, starts, ends, items) if last else (n, starts, ends, sorted(items)))
        return pd.DataFrame(rows, columns=_names(_SUMMARY if last else _HIT))

    find.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(find, _SUMMARY if last else _HIT)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def covered(starts, ends) -> int:
    """Number of positions inside any of the spans."""
    total, reach = 0, 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _summary(words: int, starts, ends, items: set[str]) -> tuple:
    hit, names = covered(starts, ends), sorted(items)
    digest = hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()
    return words, hit, len(names), digest, bool(hit > 0 and 20 * hit >= words)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, i, dw.k FROM dw JOIN bw ON dw.key = bw.key AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
