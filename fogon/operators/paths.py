"""Cheapest paths from one node by frontier relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.operators.staging import drop_staged, stage


class _Goal:
    """What a search for one target may leave out.

    ``bound`` is the cost of the best known path to the target, ``last`` that of the cheapest
    edge into it. A path through another node only helps if it costs less than the bound with
    ``last`` added: at equal cost it has more edges than the known path.
    """

    def __init__(self, edges: DataFrame, source, target):
        into = edges.where(F.col("dst") == target)
        found = into.agg(
            F.min("cost").alias("last"), F.min(F.when(F.col("src") == source, F.col("cost"))).alias("direct")
        ).first()
        self.target, self.last, self.reachable = target, found.last or 0, found.last is not None
        self.bound = 0 if source == target else found.direct

    def useful(self, node: str, cost: Column) -> Column:
        if self.bound is None:
            return F.lit(True)
        # The target itself is kept at the bound, so the known path gets into the state.
        return (cost + self.last < self.bound) | ((F.col(node) == self.target) & (cost <= self.bound))

    def tighten(self, state: DataFrame) -> None:
        best = state.where(F.col("node") == self.target).agg(F.min("cost")).first()[0]
        if best is not None:
            self.bound = best if self.bound is None else min(best, self.bound)


def _relax(state: DataFrame, edges: DataFrame, hops: int, keep_path: bool, goal: _Goal | None) -> DataFrame:
    """One round: extend the nodes settled in the previous round by one edge.

    Only the frontier meets the edges, in an inner join, so Spark may split the edges of a
    hub; what it reaches is added to the state, and one minimum per node merges both.
    """
    path = F.concat("path", F.array("dst")) if keep_path else F.col("path")
    frontier = state.where(F.col("hops") == hops - 1)
    if goal is not None:
        frontier = frontier.where(F.col("node") != goal.target)
    step = edges.select(F.col("src").alias("node"), "dst", F.col("cost").alias("edge_cost"))
    reached = frontier.join(step, "node").select(
        F.col("dst").alias("node"),
        F.struct(
            (F.col("cost") + F.col("edge_cost")).alias("cost"),
            F.lit(hops).alias("hops"),
            path.alias("path"),
        ).alias("best"),
    )
    if goal is not None:
        reached = reached.where(goal.useful("node", F.col("best.cost")))
    own = state.select("node", F.struct("cost", "hops", "path").alias("best"))
    return (
        own.unionByName(reached)
        .groupBy("node")
        .agg(F.min("best").alias("best"))
        .select("node", "best.*")
    )


def cheapest_paths(
    edges: DataFrame,
    source,
    max_hops: int | None = None,
    keep_path: bool = True,
    rounds_per_write: int = 4,
    target=None,
) -> DataFrame:
    """(node, cost, hops, path) of the cheapest path from ``source`` to each node.

    With a ``target`` only its row is meant: what cannot lie on a cheaper path to it than the
    best one known (the direct edge at first) is neither kept nor extended. A target that no
    edge enters is not searched for.

    ``edges`` are (src, dst, cost) with non-negative integer costs, so comparisons are
    exact. Ties go to fewer hops, then to the smaller path. Round r only extends nodes
    whose best path was found in round r-1 (its hop count is r-1), and one min per
    node merges the results: one join and one aggregate per round, no pair of paths
    is ever held. Every few rounds the state is written, which cuts the lineage and
    tells whether anything is left to extend. Paths are not needed for costs alone;
    ``keep_path=False`` drops them.
    """
    spark = edges.sparkSession
    node_type = edges.schema["src"].dataType.simpleString()
    state = spark.range(1).select(
        F.lit(source).cast(node_type).alias("node"),
        F.lit(0).cast("bigint").alias("cost"),
        F.lit(0).alias("hops"),
        F.array(F.lit(source).cast(node_type)).alias("path"),
    )
    goal = None if target is None else _Goal(edges, source, target)
    if goal is not None and (source == target or not goal.reachable):
        return state
    hops, written = 0, None
    while max_hops is None or hops < max_hops:
        last = hops + rounds_per_write if max_hops is None else min(hops + rounds_per_write, max_hops)
        while hops < last:
            hops += 1
            state = _relax(state, edges, hops, keep_path, goal)
        previous, state = written, stage(state, "paths")
        if previous is not None:
            drop_staged(previous)
        written = state
        if goal is not None:
            goal.tighten(state)
            state = state.where(goal.useful("node", F.col("cost")))
        if written.where(F.col("hops") == hops).isEmpty():
            break
    return state
