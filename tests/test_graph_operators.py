"""Reach, PageRank and cheapest paths against small straight computations."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from fogon.functions.geo import haversine_km, tenths_half_even
from fogon.operators.pagerank import pagerank
from fogon.operators.paths import cheapest_paths
from fogon.operators.reach import descendant_counts
from fogon.plans import graph


def brute_reach(parents):
    children = {}
    for child, parent in parents:
        children.setdefault(parent, []).append(child)
    sizes = {}
    for node in children:
        seen, todo = set(), list(children[node])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += children.get(at, [])
        sizes[node] = len(seen)
    return sizes


def reach(spark, parents):
    df = spark.createDataFrame(parents, "child int, parent int")
    return {r["v"]: r["network_size"] for r in descendant_counts(df).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_reach_on_random_forest(spark, seed):
    rng = random.Random(seed)
    parents = [(v, rng.randrange(v)) for v in range(1, 200) if rng.random() < 0.6]
    assert reach(spark, parents) == brute_reach(parents)


def test_reach_on_a_long_chain(spark):
    parents = [(v, v - 1) for v in range(1, 100)]
    assert reach(spark, parents) == {v: 99 - v for v in range(99)}


def test_reach_of_a_hub(spark):
    parents = [(v, 0) for v in range(1, 500)] + [(1000, 1)]
    assert reach(spark, parents) == {0: 500, 1: 1}


def test_reach_with_cycles_counts_each_node_once(spark):
    parents = [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (7, 7), (8, 7), (10, 9), (11, 10)]
    assert reach(spark, parents) == brute_reach(parents)


@pytest.mark.parametrize("seed", range(4))
def test_reach_with_several_parents_and_cycles(spark, seed):
    rng = random.Random(50 + seed)
    parents = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice((40, 70, 110)))]
    assert reach(spark, parents + parents[:5]) == brute_reach(parents)


def test_reach_keeps_every_parent(spark):
    # 3 has two parents; the paths over 3 and 4 meet again in 5.
    parents = [(3, 1), (3, 2), (4, 1), (5, 3), (5, 4), (6, 5)]
    assert reach(spark, parents) == brute_reach(parents) == {1: 4, 2: 3, 3: 2, 4: 2, 5: 1}


def brute_pagerank(edges, iterations=20):
    nodes = {n for e in edges for n in e}
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    rank = dict.fromkeys(nodes, 0.15)
    for _ in range(iterations):
        gain = dict.fromkeys(nodes, 0.0)
        for n in nodes:
            for d in out[n]:
                gain[d] += rank[n] / len(out[n])
        rank = {n: 0.15 + 0.85 * gain[n] for n in nodes}
    return {d: rank[d] for _, d in edges}


@pytest.mark.parametrize("seed", range(2))
def test_pagerank_on_random_graph(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(40)})
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r["id"]: r["rank"] for r in pagerank(df).collect()}
    want = brute_pagerank(edges)
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


def dijkstra(edges, source):
    best, todo = {}, [(0, 0, [source])]
    while todo:
        cost, hops, path = heapq.heappop(todo)
        if path[-1] in best:
            continue
        best[path[-1]] = (cost, hops, path)
        for s, d, w in edges:
            if s == path[-1] and d not in best:
                heapq.heappush(todo, (cost + w, hops + 1, [*path, d]))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_paths_on_sparse_graph(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(40)})
    edges = [(s, d, rng.randrange(0, 9)) for s, d in pairs if s != d]
    df = spark.createDataFrame(edges, "src int, dst int, cost bigint")
    got = {r["node"]: (r["cost"], r["hops"], r["path"]) for r in cheapest_paths(df, 0).collect()}
    assert got == dijkstra(edges, 0)


@pytest.mark.parametrize("seed", range(2))
def test_path_to_one_target_equals_the_search_for_all(spark, seed):
    rng = random.Random(100 + seed)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(45)})
    edges = [(s, d, rng.randrange(0, 6)) for s, d in pairs if s != d]
    df = spark.createDataFrame(edges, "src int, dst int, cost bigint")
    want = dijkstra(edges, 0)
    for target in (0, 3, 7, 11, 99):
        found = cheapest_paths(df, 0, target=target, rounds_per_write=2).where(F.col("node") == target).collect()
        assert {r["node"]: (r["cost"], r["hops"], r["path"]) for r in found} == {
            t: v for t, v in want.items() if t == target
        }


def test_search_for_a_near_target_settles_few_nodes(spark):
    """A chain with a dear direct edge: nodes behind the target are never kept."""
    chain = [(i, i + 1, 1) for i in range(300)] + [(0, i, 1000) for i in range(1, 301, 7)]
    df = spark.createDataFrame([*chain, (0, 6, 20)], "src int, dst int, cost bigint")
    state = cheapest_paths(df, 0, target=6).collect()
    assert {r["node"]: r["cost"] for r in state}[6] == 6
    assert len(state) <= 8


def test_bounded_paths_equal_listing_all_trails(spark):
    rng = random.Random(5)
    edges = [(s, d, rng.randrange(1, 50)) for s in range(6) for d in range(6) if s != d]
    df = spark.createDataFrame(edges, "src int, dst int, cost bigint")
    got = {r["node"]: r["cost"] for r in cheapest_paths(df, 0, max_hops=3).collect()}

    def trails(node, used, cost, left):
        yield node, cost
        if left:
            for e in edges:
                if e[0] == node and e not in used:
                    yield from trails(e[1], [*used, e], cost + e[2], left - 1)

    want = {}
    for node, cost in trails(0, [], 0, 3):
        want[node] = min(cost, want.get(node, cost))
    assert got == want


def test_known_distance(spark):
    km = spark.range(1).select(
        haversine_km(F.lit(9.9333), F.lit(-84.0833), F.lit(9.8644), F.lit(-83.9194))
    ).first()[0]
    assert 18 < km < 26


def test_tenths_round_the_stored_value_half_to_even(spark):
    values = [i / 1000 / 28 * 60 for i in range(0, 3000, 7)] + [0.15, 0.25, 0.35, 0.45, 0.75, 1.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", tenths_half_even(F.col("v")).alias("t")).collect():
        assert row["t"] == round(round(row["v"], 1) * 10), row


def test_route_mesh_is_complete_and_symmetric(spark, sources):
    rows = graph.route_mesh(sources["locations"]).collect()
    assert {(r["src"], r["dst"]) for r in rows} == {("north", "south"), ("south", "north")}
    assert len({(r["distance_km"], r["minutes"]) for r in rows}) == 1


def test_route_mesh_plan_has_no_cross_join(spark, sources):
    plan = graph.route_mesh(sources["locations"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_recommended_skips_blank_and_unknown_referrers(spark):
    users = spark.createDataFrame(
        [("a", ""), ("b", "a"), ("c", "zz"), ("d", None)], "user_id string, referred_by string"
    )
    assert [tuple(r) for r in graph.recommended(users).collect()] == [("a", "b")]


def test_contains_keeps_the_last_quantity(spark, sources):
    again = sources["order_items"].unionByName(
        spark.createDataFrame([("i9", "o1", "p1", 7, 3800, 3800)], sources["order_items"].schema)
    )
    rows = {
        (r["order_id"], r["product_id"]): r["quantity"]
        for r in graph.contains(again, sources["orders"], sources["products"]).collect()
    }
    assert rows == {("o1", "p1"): 7, ("o1", "p2"): 1, ("o2", "p1"): 1}


def test_also_bought_with_a_repeated_seed_name(spark):
    products = spark.createDataFrame(
        [(1, "s", "x"), (2, "s", "x"), (3, "o", "y"), (4, "p", "y")],
        "product_id int, name string, category string",
    )
    items = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 4), (3, 3)], "order_id int, product_id int"
    )
    rows = [(r["product_id"], r["support"]) for r in graph.also_bought(items, products, "s").collect()]
    assert rows == [(3, 2), (1, 1), (2, 1)]


def test_route_queries_name_districts(spark, sources):
    mesh = graph.route_mesh(sources["locations"])
    short = graph.route_shortest_path(mesh, sources["locations"], "north", "south").first()
    assert short["route"] == ["Pino-1", "Mar-3"]
    eta = {r["location_id"]: r["eta_minutes"] for r in
           graph.route_eta_from_source(mesh, sources["locations"], "north").collect()}
    assert eta["north"] == 0 and eta["south"] == short["total_minutes"]
    with pytest.raises(ValueError):
        graph.route_bounded_path(mesh, sources["locations"], "north", "north")
