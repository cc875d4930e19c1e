from __future__ import annotations

from oracle.base import haversine, with_ctes

MEMBERS = "SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem"
REC = """
SELECT DISTINCT u.referred_by AS src, u.user_id AS dst FROM users u JOIN users r ON r.user_id = u.referred_by"""

_X = "distance_km / CAST(28.0 AS DOUBLE) * 60"
_J = f"CAST(floor(({_X}) * 10) AS BIGINT)"
_SIDE = f"((({_X}) * 16 - CAST(2 * {_J} + 1 AS DOUBLE)) + ({_X}) * 4)"
MESH = f"""
SELECT src, dst, distance_km, tenths, CAST(tenths AS DOUBLE) / 10 AS minutes,
       CAST(round(distance_km * 1000) AS BIGINT) AS metres
FROM (SELECT *, {_J} + CASE WHEN {_SIDE} > 0 OR ({_SIDE} = 0 AND {_J} % 2 = 1) THEN 1 ELSE 0 END AS tenths
      FROM (SELECT a.location_id AS src, b.location_id AS dst,
                   round(CASE WHEN a.location_id < b.location_id
                         THEN {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}
                         ELSE {haversine('b.latitude', 'b.longitude', 'a.latitude', 'a.longitude')} END, 3) AS distance_km
            FROM locations a JOIN locations b ON a.location_id <> b.location_id))"""


def relaxation(source: int, cost: str, rounds: int) -> dict[str, str]:
    """Unrolled rounds: best (cost, hops, path) per node after each round."""
    ctes = {
        "r0": f"SELECT CAST({source} AS INTEGER) AS node, CAST(0 AS BIGINT) AS cost, 0 AS hops, "
        f"[CAST({source} AS INTEGER)] AS path"
    }
    for n in range(1, rounds + 1):
        ctes[f"r{n}"] = f"""
SELECT node, cost, hops, path FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, hops, path) AS rn FROM (
    SELECT node, cost, hops, path FROM r{n - 1}
    UNION ALL
    SELECT m.dst, p.cost + m.{cost}, {n}, list_append(p.path, m.dst)
    FROM r{n - 1} p JOIN mesh m ON m.src = p.node WHERE p.hops = {n - 1}))
WHERE rn = 1"""
    return ctes


def route_names(last: str, target: int) -> str:
    return f"""
SELECT string_agg(district, ' > ' ORDER BY pos) AS route, cost
FROM (SELECT cost, unnest(path) AS stop, generate_subscripts(path, 1) AS pos FROM {last} WHERE node = {target})
JOIN locations ON location_id = stop GROUP BY cost"""


# Enough rounds for the mesh: the last round is checked in the tests to change nothing.
ROUNDS = 24
SOURCE, TARGET = 0, 124
SEED = "blue anvil"

PAGERANK = """
WITH RECURSIVE {ctes},
deg AS (SELECT src, count(*) AS n FROM rec GROUP BY src),
pr(id, rank) AS (
  SELECT user_id, CAST(0.15 AS DOUBLE) FROM users WHERE user_id NOT IN (SELECT dst FROM rec)
  UNION ALL
  SELECT rec.dst, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * (pr.rank / deg.n)
  FROM pr JOIN rec ON rec.src = pr.id JOIN deg ON deg.src = rec.src)
SELECT user_id, full_name AS name, round(rank, 4) AS pagerank
FROM pr JOIN users ON user_id = id ORDER BY pagerank DESC, user_id LIMIT 10"""

REACH_BODY = """
, reach(root, node) AS (
  SELECT src, dst FROM rec UNION SELECT reach.root, rec.dst FROM reach JOIN rec ON rec.src = reach.node)
SELECT user_id, full_name AS name, count(DISTINCT node) AS network_size
FROM reach JOIN users ON user_id = root GROUP BY ALL ORDER BY network_size DESC, user_id LIMIT 10"""


def _recursive(body: str) -> str:
    head = with_ctes(["users"], "", {"rec": REC}, recursive=True).rstrip()
    return head + body


NODES = """
SELECT 'Location' AS label, CAST(location_id AS VARCHAR) AS node_id, district AS name FROM locations
UNION ALL SELECT 'Product', CAST(product_id AS VARCHAR), name FROM products
UNION ALL SELECT 'User', CAST(user_id AS VARCHAR), full_name FROM users
UNION ALL SELECT 'Order', CAST(order_id AS VARCHAR), status FROM order_rows"""

SQL = {
    "graph_nodes": with_ctes(["locations", "products", "order_rows"], NODES),
    "graph_counts": with_ctes(
        ["locations", "products", "order_rows"],
        f"SELECT label, count(*) AS n_nodes FROM ({NODES}) GROUP BY label",
    ),
    "graph_edges_lives_in": with_ctes(
        ["locations", "users"], "SELECT user_id, location_id FROM users JOIN locations USING (location_id)"
    ),
    "graph_edges_placed": with_ctes(
        ["order_rows"], "SELECT o.user_id, order_id FROM order_rows o JOIN users u ON u.user_id = o.user_id"
    ),
    "graph_edges_recommended": with_ctes(["users"], REC),
    "graph_edges_contains": f"""
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC,
        l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC,
        l_shipdate DESC) AS rn FROM lineitem)
WHERE rn = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)""",
    "graph_edges_route": with_ctes(["locations"], f"SELECT src, dst, distance_km, minutes FROM ({MESH})"),
    "copurchase_top_pairs": f"""
WITH m AS ({MEMBERS})
SELECT a.i AS product_id_a, pa.p_name AS product_a, b.i AS product_id_b, pb.p_name AS product_b, count(*) AS times_together
FROM m a JOIN m b ON a.g = b.g AND a.i < b.i JOIN part pa ON pa.p_partkey = a.i JOIN part pb ON pb.p_partkey = b.i
GROUP BY ALL ORDER BY times_together DESC, product_id_a, product_id_b LIMIT 5""",
    "also_bought": f"""
WITH m AS ({MEMBERS})
SELECT b.i AS product_id, pb.p_name AS recommended, pb.p_type AS category, count(DISTINCT a.g) AS support
FROM m a JOIN part pa ON pa.p_partkey = a.i AND pa.p_name = '{SEED}'
JOIN m b ON a.g = b.g AND a.i <> b.i JOIN part pb ON pb.p_partkey = b.i
GROUP BY ALL ORDER BY support DESC, product_id LIMIT 5""",
    "category_affinity": f"""
WITH m AS (SELECT DISTINCT l_orderkey AS g, p_type AS i FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.i AS cat_a, b.i AS cat_b, count(*) AS baskets
FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL ORDER BY baskets DESC, cat_a, cat_b LIMIT 10""",
    "referrers_direct": with_ctes(
        ["users"],
        "SELECT user_id, full_name AS name, count(*) AS direct_referrals FROM rec JOIN users ON user_id = src "
        "GROUP BY ALL ORDER BY direct_referrals DESC, user_id LIMIT 10",
        {"rec": REC},
    ),
    "referral_reach": _recursive(REACH_BODY),
    "referral_pagerank": _recursive(
        PAGERANK[PAGERANK.index("{ctes}") + len("{ctes}"):]
    ),
    "route_shortest_path": with_ctes(
        ["locations"],
        f"SELECT route, CAST(cost AS DOUBLE) / 10 AS total_minutes FROM ({route_names(f'r{ROUNDS}', TARGET)})",
        {"mesh": MESH, **relaxation(SOURCE, "tenths", ROUNDS)},
    ),
    "route_eta_from_source": with_ctes(
        ["locations"],
        f"SELECT location_id, district, zone, CAST(cost AS DOUBLE) / 10 AS eta_minutes "
        f"FROM r{ROUNDS} JOIN locations ON location_id = node",
        {"mesh": MESH, **relaxation(SOURCE, "tenths", ROUNDS)},
    ),
    "route_bounded_path": with_ctes(
        ["locations"],
        f"SELECT route, CAST((cost + 5) // 10 AS DOUBLE) / 100 AS total_km FROM ({route_names('r4', TARGET)})",
        {"mesh": MESH, **relaxation(SOURCE, "metres", 4)},
    ),
}
