"""Most frequent item pairs over groups (baskets), exact and safe for huge groups.

A group with w items holds w*(w-1)/2 pairs, so one basket with a large share of the
rows would swamp the job if its pairs were written. Pairs are written only for groups of
at most ``wide`` items, which makes at most wide/2 pairs a row. All wider groups are
counted as an items x groups incidence: their items are dealt into blocks, a task streams
the rows of two blocks group by group, adds up the products of the incidences, adds what
the narrow groups contributed to the same pairs, and returns the ``k`` best pairs of its
two blocks. So a wide group writes no pair at all, a hot item is one row of a block and a
hot group is spread over all block pairs; no pair is left out. Every input takes both
ways, and ``wide`` only says which groups go which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.operators.staging import stage

#: Items of a block; a task holds the counts of BLOCK x BLOCK pairs.
BLOCK = 1024
#: Groups whose incidence a task holds at a time.
GROUPS_AT_ONCE = 2048


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """Top k with a total order: count, then the two item ids."""
    return pairs.orderBy(F.desc("n"), "a", "b").limit(k)


def _narrow_pairs(narrow: DataFrame, fold: bool) -> DataFrame:
    """Pair counts within groups of bounded size; (a, b, n) with a < b.

    With ``fold``, groups holding the same items are counted together first, which
    pays off when there are few distinct items.
    """
    baskets = narrow.groupBy("g").agg(F.sort_array(F.collect_set("i")).alias("items"))
    if fold:
        baskets = baskets.groupBy("items").agg(F.count("*").alias("w"))
    else:
        baskets = baskets.select("items", F.lit(1).cast("bigint").alias("w"))
    first = baskets.where(F.size("items") > 1).select(
        "w", "items", F.posexplode("items").alias("pos", "a")
    )
    rest = F.slice("items", F.col("pos") + 2, F.size("items"))
    return (
        first.select("w", "a", F.explode(rest).alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("w").alias("n"))
    )


class _BlockPair:
    """Counts of the pairs between two blocks of items, fed group by group."""

    def __init__(self):
        self.rows: dict = {}
        self.counts = np.zeros((0, 0))
        self.groups: list[list[int]] = []
        self.extra: dict[tuple[int, int], int] = {}

    def _row(self, item) -> int:
        return self.rows.setdefault(item, len(self.rows))

    def add_group(self, items: list) -> None:
        self.groups.append([self._row(i) for i in items])
        if len(self.groups) == GROUPS_AT_ONCE:
            self._count()

    def add_pair(self, a, b, n: int) -> None:
        self.extra[self._row(a), self._row(b)] = n

    def _count(self) -> None:
        size = len(self.rows)
        incidence = np.zeros((size, max(1, len(self.groups))), dtype="float32")
        for column, items in enumerate(self.groups):
            incidence[items, column] = 1
        grown = np.zeros((size, size))
        old = self.counts.shape[0]
        grown[:old, :old] = self.counts
        self.counts = grown + incidence @ incidence.T
        self.groups = []

    def best(self, k: int, block: dict, i: int, j: int) -> list[tuple]:
        """(a, b, n) of the k best pairs with one item in block i and one in block j."""
        self._count()
        for (a, b), n in self.extra.items():
            self.counts[a, b] += n
            self.counts[b, a] += n
        items = list(self.rows)
        order = sorted(range(len(items)), key=items.__getitem__)
        where = np.array([block[items[p]] for p in order])
        counts = self.counts[np.ix_(order, order)]
        wanted = np.triu(counts, 1) > 0
        wanted &= (where[:, None] == i) & (where[None, :] == j) | (where[:, None] == j) & (where[None, :] == i)
        left, right = np.nonzero(wanted)
        n = counts[left, right].astype("int64")
        top = np.lexsort((right, left, -n))[:k]
        return [(items[order[left[t]]], items[order[right[t]]], int(n[t])) for t in top]


def _best_of_blocks(k: int, out: pa.Schema):
    """Task: rows (i, j, g, kind, a, block_a, b, block_b, n) sorted by (i, j, g) -> best pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        pair, counts, block, group, items = None, None, {}, None, []

        def close() -> None:
            if counts is not None:
                if items:
                    counts.add_group(items)
                found.extend(counts.best(k, block, *pair))

        for batch in batches:
            for i, j, g, is_pair, a, block_a, b, block_b, n in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if (i, j) != pair:
                    close()
                    pair, counts, block, group, items = (i, j), _BlockPair(), {}, None, []
                if is_pair:
                    block[a], block[b] = block_a, block_b
                    counts.add_pair(a, b, n)
                    continue
                if g != group:
                    if items:
                        counts.add_group(items)
                    group, items = g, []
                block[a] = block_a
                items.append(a)
        close()
        if found:
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.types, strict=True)], schema=out
            )

    return work


def _wide_pairs(wide_rows: DataFrame, narrow_pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of every block pair of the items of ``wide_rows`` (g, i), counted
    over wide and narrow groups."""
    items = wide_rows.select("i").distinct()
    # One number: how many blocks the items make.
    blocks = max(1, -(-items.count() // BLOCK))
    in_block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    number = items.select("i", in_block.alias("block"))
    item_type = wide_rows.schema["i"].dataType
    copies = (
        wide_rows.select("g", "i", in_block.alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(
            F.least("block", "other").alias("i_"), F.greatest("block", "other").alias("j_"), "g",
            F.lit(False).alias("is_pair"), F.col("i").alias("a"), F.col("block").alias("block_a"),
            F.lit(None).cast(item_type).alias("b"), F.lit(None).cast("int").alias("block_b"),
            F.lit(None).cast("bigint").alias("n"),
        )
    )
    pairs = (
        narrow_pairs.join(number.select(F.col("i").alias("a"), F.col("block").alias("block_a")), "a")
        .join(number.select(F.col("i").alias("b"), F.col("block").alias("block_b")), "b")
        .select(
            F.least("block_a", "block_b").alias("i_"), F.greatest("block_a", "block_b").alias("j_"),
            F.lit(None).cast(wide_rows.schema["g"].dataType).alias("g"), F.lit(True).alias("is_pair"),
            "a", "block_a", "b", "block_b", "n",
        )
    )
    dealt = copies.unionByName(pairs).repartition("i_", "j_").sortWithinPartitions("i_", "j_", "g")
    out = narrow_pairs.select("a", "b", "n")
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.schema.fields])
    return dealt.mapInArrow(_best_of_blocks(k, arrow), out.schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def top_pairs(
    rows: DataFrame,
    group: str,
    item: str,
    k: int,
    wide: int = 64,
    fold: bool = False,
) -> DataFrame:
    """The ``k`` item pairs (a < b) that share the most groups: columns a, b, n.

    A group counts as wide when it has more than ``wide`` distinct items.
    """
    members = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna().distinct()
    wide_groups = (
        members.groupBy("g").agg(F.count("*").alias("width")).where(F.col("width") > wide).select("g")
    )
    narrow = stage(_narrow_pairs(members.join(wide_groups, "g", "left_anti"), fold), "narrow-pairs")
    wide_rows = stage(members.join(wide_groups, "g", "left_semi"), "wide-members")
    dense = _wide_pairs(wide_rows, narrow, k)
    # A pair of two wide items comes from its block with all groups counted; its narrow
    # share alone is never larger.
    best = _ranked(narrow, k).unionByName(dense).groupBy("a", "b").agg(F.max("n").alias("n"))
    return _ranked(best, k)
