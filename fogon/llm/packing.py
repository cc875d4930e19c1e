"""Best-fit packing of token sequences by linear grouping.

The lengths are integers up to the capacity, so the whole input is described by a histogram
of at most ``capacity`` numbers, whatever its size. Only that histogram reaches the driver.

1. Large lengths (over ``capacity // 8``) are sorted and cut into groups of equal
   cardinality; each length is rounded up to the largest of its group.
2. Over these few sizes configurations (multisets that fit a sequence) are optimised: the linear
   program of the fewest sequences is solved by column generation, a knapsack giving the
   next configuration until none improves it. A configuration is used the whole number of
   times its variable says, or a share of that (below).
3. Actual documents take the places of the rounded ones: in each place the longest open document
   that leaves room for the places after it, so the room that rounding had cost is used.
4. All other documents, the small ones and those of large lengths that no configuration took, are
   placed by best fit, longest first: always into the sequences with the least room that is
   enough, new sequences only if none has room.

Rounding wastes room that only step 4 can fill, so the best share of the configurations depends on
the lengths: with few small documents it is all of them, with many a small part. Steps 3 and 4 run for the
shares 1, 1/2, ... 1/4096 and the plan with the fewest sequences is kept (the largest share among equals).

All steps work on runs (so many sequences alike), so the plan has some thousands of
rows that depend on the capacity and the number of groups, not on the documents. A plan row
says: documents of this length with ranks [first, first + count) go to sequences
[sequence, sequence + count) at this offset. Ranks are counted by Spark per part and length.

Defined cases: a null text is the empty one (only the end id); pieces are cut only from
documents longer than the capacity; repeated rows are packed each; null document ids stay
null; an empty table packs to no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogon.llm.common import docs_of, emit, write_stage
from fogon.llm.tokens import encoder

GROUPS = 64
SHARES = tuple(2.0**-i for i in range(13))

#: (length, first rank, count, first sequence, offset)
Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """Where the documents of each length go; covers every document once."""
    counts = np.zeros(capacity + 1, dtype="int64")
    for length, n in histogram.items():
        counts[length] = n
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    sizes, need = _grouped(counts, capacity // 8, groups)
    configurations = _configurations(sizes, need, capacity)
    best: tuple[int, list[Run]] | None = None
    for share in SHARES:
        runs, n = _place(counts, [(places, int(times * share)) for places, times in configurations], capacity)
        if best is None or n < best[0]:
            best = n, runs
        if best[0] == least:
            break
    return best[1]


def _grouped(counts: np.ndarray, small: int, groups: int) -> tuple[list[int], list[int]]:
    """Rounded sizes of the lengths over ``small``, largest first, and how many documents each stands for."""
    upto = np.cumsum(counts[:small:-1])  # documents from the longest down to each length
    total = int(upto[-1])
    if not total:
        return [], []
    first = np.arange(0, total, -(-total // groups))
    size = len(counts) - 1 - np.searchsorted(upto, first, side="right")
    need: dict[int, int] = defaultdict(int)
    for length, n in zip(size.tolist(), np.diff([*first, total]).tolist(), strict=True):
        need[length] += n
    return list(need), list(need.values())


def _configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes of a configuration, how often), fullest first: a basis of the linear program, rounded down."""
    k = len(sizes)
    if not k:
        return []
    values = np.array([0, *sizes])  # 0: an empty place
    before = np.arange(capacity + 1) - values[:, None]
    fits, before = before >= 0, np.maximum(before, 0)
    basis = np.diag([float(capacity // x) for x in sizes])
    for _ in range(50 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        # The dearest filling, place by place.
        worth, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            offers = np.where(fits, worth[before] + np.array([0, *price])[:, None], -1.0)
            choices.append(offers.argmax(axis=0))
            worth = offers.max(axis=0)
        if worth[capacity] <= 1 + 1e-7:
            break
        column, at = np.zeros(k), capacity
        for choice in reversed(choices):
            if choice[at]:
                column[choice[at] - 1] += 1
            at -= values[choice[at]]
        times, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.full(k, np.inf)
        np.divide(np.maximum(times, 0), change, out=ratio, where=change > 1e-9)
        basis[:, ratio.argmin()] = column
    times = np.floor(np.linalg.solve(basis, need) + 1e-6).astype("int64")
    out = [([x for x, a in zip(sizes, basis[:, j], strict=True) for _ in range(int(a))], int(times[j])) for j in range(k)]
    return sorted(out, key=lambda c: (-sum(c[0]), c[0]))


def _place(counts: np.ndarray, configurations: list[tuple[list[int], int]], capacity: int) -> tuple[list[Run], int]:
    """Runs and number of sequences: documents in the places of configurations, the others by best fit."""
    open_ = counts.copy()
    open_[0] = 0
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (sequence, how many)
    sequences = 0

    def put(length: int, r: int, sequence: int, n: int) -> None:
        runs.append((length, int(counts[length] - open_[length]), n, sequence, capacity - r))
        open_[length] -= n

    for places, times in configurations:
        if times <= 0:
            continue
        now, later = [(capacity, sequences, times)], sum(places)
        sequences += times
        for size in places:
            later -= size
            after = []
            for r, sequence, n in now:
                while n:
                    fit = np.flatnonzero(open_[capacity // 8 + 1 : r - later + 1])
                    if not len(fit):
                        after.append((r, sequence, n))
                        break
                    length = capacity // 8 + 1 + int(fit[-1])
                    use = min(n, int(open_[length]))
                    put(length, r, sequence, use)
                    after.append((r - length, sequence, use))
                    sequence, n = sequence + use, n - use
            now = after
        for r, sequence, n in now:
            room[r].append((sequence, n))

    levels = np.zeros(capacity + 1, dtype=bool)
    levels[list(room)] = True
    for length in range(capacity, 0, -1):
        while left := int(open_[length]):
            fit = np.flatnonzero(levels[length:])
            if len(fit):
                r = length + int(fit[0])
                sequence, n = room[r].pop()
                levels[r] = bool(room[r])
            else:
                # As many documents of this length as fit share each new sequence.
                r, sequence, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            use = min(n, left)
            if use < n:
                room[r].append((sequence + use, n - use))
                levels[r] = True
            put(length, r, sequence, use)
            room[r - length].append((sequence, use))
            levels[r - length] = True
    return runs, sequences


# ---- Spark job --------------------------------------------------------------------

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64()),
    ]
)
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of the documents of (doc_id, text) with their place among equals of their part."""
    end = struct.pack("<I", end_id)

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def rows():
            for doc_id, text in docs_of(batches):
                ids = encoder(tokenizer).encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    length = len(cut) // 4
                    yield doc_id, piece, at // 4, length, zlib.crc32(cut), part, seen[length]
                    seen[length] += 1

        yield from emit(rows(), _PIECES, 5000)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """Pieces with their sequence and offset.

    The pieces (some 60 bytes each, no ids) are written once, which fixes their places. The
    ranks and the plan are looked up per (part, length), so no key gathers more than a part.
    """
    spark = docs.sparkSession
    path = write_stage(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    pieces = spark.read.schema(_PIECES_SQL).parquet(path)
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most as many rows per length as there are parts.
    order = Window.partitionBy("length").orderBy("part")
    base = per_part.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, capacity, groups)), dtype="int64").reshape(-1, 5)
    # One number per run that grows with (length, rank), so a bisection finds the run.
    span = int(max(histogram.values(), default=0)) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def look_up(batches):
        for b in batches:
            key = b.column("length").to_numpy() * span + b.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            sequence = runs[at, 3] + key - keys[at]
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(sequence), pa.array(runs[at, 4])],
                names=[*b.schema.names[:-1], "sequence_id", "offset"],
            )

    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        look_up,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
