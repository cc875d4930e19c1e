"""Helpers shared by the training-data operators.

Words follow one rule everywhere: A-Z are lower-cased, and a word is a maximal run of
ASCII letters, digits and code points from U+0080 on. On UTF-8 bytes that is one table
look-up per byte, so a text is cut into words by two C calls.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.operators.staging import fresh_dir
from fogon.sources.files import delete_folder

# Every byte of a separator becomes a blank, A-Z become a-z, the rest stays.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split() if text else []


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: documents are large rows, and a worker holds a batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL options for the actions inside; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers wait for their next task
    with all they once allocated. Called where a task's rows end."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Interned(dict):
    """Word -> value of ``make(word)``, emptied at ``limit`` entries to bound its memory."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as plain tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)
    held.clear()
    give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; the held-out fold is 2. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def write_stage(df: DataFrame, label: str) -> str:
    """Write ``df`` into the cluster's shared folder and return the path."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return path


def drop_stage(*paths: str) -> None:
    """Remove written intermediates that no later step reads."""
    for path in paths:
        delete_folder(path)


def in_key_order(df: DataFrame, key: str, extra: list[str], rows: int = 8192, with_next: bool = False) -> DataFrame:
    """Deal rows to tasks in ranges of ``key``, each range sorted; no task sees all rows.

    Ranges are cut at approximate quantiles of the key and hold about ``rows`` rows, so
    only one number per range passes through the driver. The result has ``pid`` (number
    of the range), ``ghost``, ``k`` (the key) and ``extra``; a task holds one range, sorted
    by (ghost, k, extra). Null keys come first, repeated keys are ordered by ``extra``.
    With ``with_next`` the first row of each range is also sent to the range before it,
    marked ``ghost`` (that of the first range to the last), so every row meets its successor.
    """
    df = df.select(F.col(key).cast("long").alias("k"), *extra)
    rank = F.coalesce("k", F.lit(_FIRST))
    total = df.count()
    n = -(-total // rows)
    cuts: list[int] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(df.agg(F.percentile_approx(rank, shares, 10_000)).first()[0]))
    bounds = np.array(cuts, dtype="int64")

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right"))

    dealt = df.withColumn("pid", range_of(rank))
    if with_next:
        found = dealt.groupBy("pid").agg(F.min(rank).alias("k")).collect()  # a row per range
        firsts = sorted((r.pid, r.k) for r in found)
        before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

        @F.pandas_udf("own int, before int")
        def ranges_of(k: pd.Series) -> pd.DataFrame:
            own = np.searchsorted(bounds, k.to_numpy(), side="right")
            return pd.DataFrame({"own": own, "before": k.map(before).astype("Int32")})

        both = ranges_of(rank).alias("both")
        dealt = df.select("k", *extra, both).select(
            "k", *extra, F.explode(F.array(
                F.struct(F.col("both.own").alias("pid"), F.lit(0).alias("ghost")),
                F.struct(F.col("both.before").alias("pid"), F.lit(1).alias("ghost")),
            )).alias("to"),
        ).select("to.pid", "to.ghost", "k", *extra).where("pid IS NOT NULL")
    else:
        dealt = dealt.select("pid", F.lit(0).alias("ghost"), "k", *extra)
    return dealt.repartitionById(len(cuts) + 1, F.col("pid")).sortWithinPartitions("pid", "ghost", "k", *extra)


_FIRST = -(2**63)
