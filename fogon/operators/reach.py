"""Size of every node's descendant set in a parent graph; a child may have several parents.

Where every child has one parent the graph is a forest and doubling counts it: with S(v)
descendants of v nearer than 2^r (v included) and anc(v) its 2^r-th ancestor, one round
adds S(u) of all u with anc(u) = v to S(v) and replaces anc by anc(anc). Depth d takes
log2(d)+1 rounds over n rows; the closure, which can be quadratic, is never built. Sums
are combined map-side, so a node with a huge number of children is one partial sum per task.

A child with several parents is cut off from all of them and becomes the root of its own
tree. What its former parents and their ancestors reach is then put together from whole
trees: each tree is one number, a node's set of trees is made distinct, and so every
descendant counts once however many paths lead to it. Only ancestors of such children enter
that step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.operators.staging import drop_staged, stage


def _double(state: DataFrame) -> DataFrame:
    """One doubling round over (v, anc, size).

    A root looks itself up, so the many rows without an ancestor keep distinct join
    keys instead of meeting in one task. Each row then hands on its own size with the
    new ancestor and, to its current ancestor, its size; one aggregate merges them.
    """
    jump = state.select(F.col("v").alias("key"), F.col("anc").alias("next_anc"))
    none = F.lit(None).cast(state.schema["anc"].dataType)
    own = F.struct("v", F.col("next_anc").alias("anc"), "size")
    pushed = F.struct(F.col("anc").alias("v"), none.alias("anc"), "size")
    return (
        state.withColumn("key", F.coalesce("anc", "v"))
        .join(jump, "key")
        .select(F.explode(F.array(own, pushed)).alias("m"))
        .select("m.*")
        .where(F.col("v").isNotNull())
        .groupBy("v")
        # One row a node carries its ancestor, the others carry null.
        .agg(F.max("anc").alias("anc"), F.sum("size").alias("size"))
    )


def _climb(walkers: DataFrame, state: DataFrame) -> DataFrame:
    """(start, v) with the 2^r-th ancestors of all v added: after round r, all nearer than 2^(r+1)."""
    up = walkers.join(state.where(F.col("anc").isNotNull()).select("v", "anc"), "v")
    return walkers.unionByName(up.select("start", F.col("anc").alias("v"))).distinct()


def _forest_sizes(
    nodes: DataFrame, walkers: DataFrame, max_rounds: int
) -> tuple[DataFrame, DataFrame, bool]:
    """(v, anc, size) after doubling, ``walkers`` with all ancestors, and whether some
    chain never ended (a cycle).

    Every round is written: it is read twice by the next one.
    """
    state = stage(nodes.withColumn("size", F.lit(1).cast("bigint")), "reach")
    for _ in range(max_rounds):
        climbed = stage(_climb(walkers, state), "climb")
        previous, state = state, stage(_double(state), "reach")
        drop_staged(previous)
        drop_staged(walkers)
        walkers = climbed
        if state.where(F.col("anc").isNotNull()).isEmpty():
            return state, walkers, False
    return state, walkers, True


def _cycle_members(cycle: DataFrame, rounds: int) -> DataFrame:
    """(v, label): nodes of one cycle share the smallest id on it."""
    state = stage(cycle.select("v", "anc", F.col("v").alias("label")), "cycle")
    for _ in range(rounds):
        ahead = state.select(
            F.col("v").alias("anc"), F.col("anc").alias("anc2"), F.col("label").alias("l2")
        )
        step = state.join(ahead, "anc").select(
            "v", F.col("anc2").alias("anc"), F.least("label", "l2").alias("label")
        )
        previous, state = state, stage(step, "cycle")
        drop_staged(previous)
    return state.select("v", "label")


def _tree_closure(trees: DataFrame) -> DataFrame:
    """All (src, dst) with a path from tree src to tree dst, by squaring the pairs."""
    pairs = stage(trees.distinct(), "trees")
    known = pairs.count()
    while known:
        ahead = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        longer = pairs.join(ahead, "dst").select("src", F.col("next").alias("dst"))
        previous, pairs = pairs, stage(pairs.unionByName(longer).distinct(), "trees")
        drop_staged(previous)
        before, known = known, pairs.count()
        if known == before:
            break
    return pairs


def _single_parent_counts(
    nodes: DataFrame, walkers: DataFrame, rounds: int
) -> tuple[DataFrame, DataFrame]:
    """(v, below, size) of a graph of one parent each, (start, v) of the walkers' ancestors.

    ``below`` is the number of descendants (on a cycle all of it and what hangs below it,
    the node itself included), ``size`` the size of the tree below v with v.
    """
    state, climbed, cyclic = _forest_sizes(nodes, walkers, rounds)
    below = state.select("v", (F.col("size") - 1).alias("below"), "size")
    if not cyclic:
        return below, climbed

    # After 2^rounds > n steps every remaining ancestor lies on a cycle, and every
    # cycle node is one. Cut the cycles, size the trees, then add up each cycle.
    on_cycle = stage(
        state.where(F.col("anc").isNotNull()).select(F.col("anc").alias("v")).distinct(),
        "on-cycle",
    )
    null_parent = F.lit(None).cast(nodes.schema["anc"].dataType)
    cut = (
        nodes.join(on_cycle.withColumn("c", F.lit(True)), "v", "left")
        .select("v", F.when(F.col("c"), null_parent).otherwise(F.col("anc")).alias("anc"))
    )
    nobody = stage(climbed.where(F.lit(False)), "climb")
    trees, _, _ = _forest_sizes(cut, nobody, rounds)
    members = _cycle_members(nodes.join(on_cycle, "v"), rounds)
    on = trees.select("v", "size").join(members, "v")
    totals = on.groupBy("label").agg(F.sum("size").alias("below"))
    cycle_rows = members.join(totals, "label").select("v", "below", F.col("below").alias("size"))
    tree_rows = trees.join(on_cycle, "v", "left_anti").select(
        "v", (F.col("size") - 1).alias("below"), "size"
    )
    return tree_rows.unionByName(cycle_rows), climbed


def descendant_counts(parents: DataFrame) -> DataFrame:
    """(v, network_size) for nodes with a descendant, from (child, parent) rows.

    Repeated rows count once. On a cycle every node reaches the whole cycle, itself
    included, and everything that hangs below it.
    """
    links = stage(
        parents.select("child", "parent").dropna().distinct(), "reach-links"
    )
    none = F.lit(None).cast(links.schema["parent"].dataType)
    by_child = links.groupBy("child").agg(
        F.count("*").alias("n"), F.min("parent").alias("parent")
    )
    # A node without a parent row is a root, and so is a child of several parents.
    nodes = stage(
        by_child.select(
            F.col("child").alias("v"),
            F.when(F.col("n") == 1, F.col("parent")).otherwise(none).alias("anc"),
        )
        .unionByName(links.select(F.col("parent").alias("v"), none.alias("anc")))
        .groupBy("v")
        .agg(F.max("anc").alias("anc")),
        "reach-nodes",
    )
    rounds = max(nodes.count(), 2).bit_length() + 1
    # The trees cut off, and the nodes they hang below: tree ``top`` below ``start``.
    hangs = stage(
        links.join(by_child.where("n > 1").select("child"), "child", "left_semi").select(
            F.col("child").alias("top"), F.col("parent").alias("start")
        ),
        "hangs",
    )
    walkers = stage(hangs.select("start", F.col("start").alias("v")).distinct(), "climb")
    single, climbed = _single_parent_counts(nodes, walkers, rounds)
    single = stage(single, "reach-single")

    tops = hangs.select("top").distinct()
    directly = stage(climbed.join(hangs, "start").select("v", "top").distinct(), "directly")
    between = directly.join(tops.withColumnRenamed("top", "v"), "v", "left_semi").select(
        F.col("v").alias("src"), F.col("top").alias("dst")
    )
    closure = _tree_closure(between)
    further = directly.join(closure.withColumnRenamed("src", "top"), "top").select(
        "v", F.col("dst").alias("top")
    )
    reached = directly.unionByName(further).distinct()
    sizes = single.select(F.col("v").alias("top"), "size")
    through = reached.join(sizes, "top").groupBy("v").agg(F.sum("size").alias("through"))
    # A node inside a tree that it reaches again is counted with that tree already.
    roots = climbed.join(nodes.where("anc IS NULL").select("v"), "v", "left_semi").select(
        "start", F.col("v").alias("top")
    )
    home = climbed.join(roots.join(tops, "top", "left_semi"), "start").select("v", "top")
    again = reached.join(home, ["v", "top"], "left_semi").select("v").distinct()
    total = (
        single.join(through, "v", "left")
        .join(again.withColumn("again", F.lit(True)), "v", "left")
        .select(
            "v",
            (
                F.when(F.col("again"), F.lit(0)).otherwise(F.col("below"))
                + F.coalesce("through", F.lit(0))
            ).alias("network_size"),
        )
    )
    return total.where("network_size > 0")
