"""PageRank by repeated joins, unnormalised: rank = (1-d) + d * sum(rank/outdegree)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.operators.staging import drop_staged, stage


def _step(ranks: DataFrame, links: DataFrame, base: float, damping: float) -> DataFrame:
    """One iteration over (id, rank). Every id has an incoming edge, so none is lost."""
    source = ranks.select(F.col("id").alias("src"), "rank")
    return (
        links.join(source, "src", "left")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.sum(F.coalesce("rank", F.lit(base)) / F.col("out")).alias("gain"))
        .select("id", (F.lit(base) + damping * F.col("gain")).alias("rank"))
    )


def pagerank(
    edges: DataFrame,
    damping: float = 0.85,
    iterations: int = 20,
    tolerance: float = 1e-7,
    rounds_per_write: int = 3,
) -> DataFrame:
    """(id, rank) of every node that has an incoming edge, from (src, dst) edges.

    A node without one keeps the base rank 1-d in every round, so only receivers are
    iterated. Every few rounds the ranks are written, which cuts the lineage; the loop
    ends after ``iterations`` or when no rank moved by ``tolerance`` since the last
    write.
    """
    base = 1.0 - damping
    outdegree = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = stage(edges.join(outdegree, "src"), "links")
    ranks = links.select(F.col("dst").alias("id")).distinct().withColumn("rank", F.lit(base))
    before = None
    for done in range(0, iterations, rounds_per_write):
        for _ in range(min(rounds_per_write, iterations - done)):
            ranks = _step(ranks, links, base, damping)
        ranks = stage(ranks, "rank")
        if before is not None:
            was = before.withColumnRenamed("rank", "was")
            change = F.max(F.abs(F.col("rank") - F.col("was")))
            moved = ranks.join(was, "id").agg(change).first()[0]
            drop_staged(before)
            if moved is None or moved < tolerance:
                break
        before = ranks
    return ranks
