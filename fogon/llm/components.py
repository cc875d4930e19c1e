"""Connected components of an edge list, by alternating star contraction.

Each round points every node's larger neighbours at its smallest one (large star), then a
node's smaller neighbours and itself at the smallest (small star). The number of edges never
grows, rounds are logarithmic in practice, and every step is a grouped minimum and a join,
so no component is gathered anywhere. Rounds are written to the shared staging folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.llm.common import drop_stage, write_stage


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of edges (a, b) of any one orderable type; also the folder
    of the last round, which the caller removes after the last read. A root is the smallest
    node of its component. Self-loops and null ends add nothing; no edges, no rows.
    """
    spark = edges.sparkSession
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = write_stage(kept, "edges")
    schema = kept.schema
    while True:
        now = spark.read.schema(schema).parquet(path)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small_least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        following = write_stage(small, "edges")
        after = spark.read.schema(schema).parquet(following)
        changed = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        drop_stage(path)
        path = following
        if not changed:
            break
    stars = spark.read.schema(schema).parquet(path)
    # At the fixed point every edge leads from a node to its root.
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), path
