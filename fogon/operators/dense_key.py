"""Dense 1..n surrogate keys without sending every row to one task."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.operators.staging import stage

# monotonically_increasing_id keeps the row's position within its partition in
# the lower 33 bits and the partition number above them.
_POSITION_BITS = 33


def range_positions(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Range-partition and sort by ``order_by``; ``_pos`` grows with that order.

    Range partitions are balanced by sampled key values, so a dense region of keys
    is spread out. ``order_by`` should be unique for the keys to be reproducible.
    """
    return (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_pos", F.monotonically_increasing_id())
    )


def dense_key(
    df: DataFrame,
    key: str,
    order_by: list[str | Column],
    key_type: str = "bigint",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``key`` = rank of the row (1..n) in the total order given by ``order_by``.

    Same values as ``row_number()`` over an unpartitioned window. The ranged rows are
    written once, so partition boundaries cannot move between the two uses; the rows
    per partition (one number per partition) become offsets that are joined back.
    ``keep`` names the columns that go on; others (a wide natural id that only orders) are
    sorted by and not written. Default: all.
    """
    spark = df.sparkSession
    ranged = range_positions(df, order_by)
    if keep is not None:
        ranged = ranged.select(*keep, "_pos")
    ranged = stage(ranged, key)
    part = F.shiftrightunsigned("_pos", _POSITION_BITS).cast("int")
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    sizes.sort()
    parts = [row["_part"] for row in sizes]
    ends = list(accumulate(row["_n"] for row in sizes))
    offsets = pa.table(
        {
            "_part": pa.array(parts, pa.int32()),
            "_offset": pa.array([0, *ends][: len(parts)], pa.int64()),
        }
    )
    # One row per range partition, so the broadcast side is bounded by the
    # partition count, not by the data.
    starts = F.broadcast(spark.createDataFrame(offsets))
    position = F.col("_pos").bitwiseAND((1 << _POSITION_BITS) - 1)
    return (
        ranged.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(key, (F.col("_offset") + position + 1).cast(key_type))
        .drop("_part", "_pos", "_offset")
    )
