from __future__ import annotations

from oracle.base import KITCHEN, haversine, with_ctes
from oracle.graph import MESH

DELIVERABLE = """
SELECT order_id, date_key AS day, round(customer_lat, 6) AS lat, round(customer_lng, 6) AS lng, zone,
       CAST(net_amount AS DOUBLE) AS net_amount
FROM orders_f LEFT JOIN (SELECT location_id, zone FROM locations) USING (location_id)
WHERE status IN ('pending', 'preparing')"""

# The assignment rule played order by order, each delivery day by itself.
ASSIGN = {
    "todo": f"SELECT order_id, day, zone FROM ({DELIVERABLE})",
    "queue": """
SELECT t.*, greatest(4, CAST(ceil(count(*) OVER (PARTITION BY day) / 10.0) AS BIGINT)) AS fleet,
       row_number() OVER (PARTITION BY day ORDER BY n DESC, first_order, order_id) AS step
FROM todo t JOIN (SELECT day, zone, count(*) AS n, min(order_id) AS first_order FROM todo GROUP BY ALL) USING (day, zone)""",
    "play(day, step, order_id, courier, loads, served)": """
SELECT DISTINCT day, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       list_transform(range(fleet), lambda i: CAST(0 AS BIGINT)), list_transform(range(fleet), lambda i: '')
FROM queue
UNION ALL
SELECT day, step, order_id, pick - 1,
       list_transform(range(1, len(loads) + 1), lambda i: loads[i] + CASE WHEN i = pick THEN 1 ELSE 0 END),
       list_transform(range(1, len(loads) + 1), lambda i: served[i] || CASE WHEN i = pick THEN '<' || zone || '>' ELSE '' END)
FROM (SELECT q.day, q.step, q.order_id, q.zone, p.loads, p.served,
             list_min(list_transform(range(1, len(p.loads) + 1), lambda i:
               CASE WHEN p.loads[i] < 10 AND contains(p.served[i], '<' || q.zone || '>') THEN 0
                    WHEN p.loads[i] < 10 THEN 1 ELSE 2 END * 1000000000000 + p.loads[i] * 1000000 + i)) % 1000000 AS pick
      FROM play p JOIN queue q ON q.day = p.day AND q.step = p.step + 1)""",
}




def _plain_ctes(ctes: dict[str, str]) -> str:
    return ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())


def _m(a: str, b: str) -> str:
    """Distance between two stops of a route (0 is the kitchen)."""
    return f"m[({a}) * (n + 1) + ({b}) + 1]"


_LAT, _LNG = KITCHEN
TOURS = {
    "stop": """
SELECT p.day, p.courier, p.order_id, t.zone, o.customer_lat AS lat, o.customer_lng AS lng, o.location_id,
       row_number() OVER (PARTITION BY p.day, p.courier ORDER BY p.order_id) AS s
FROM play p JOIN todo t USING (order_id) JOIN orders_f o USING (order_id) WHERE p.step > 0""",
    "point": f"""
SELECT day, courier, s, lat, lng FROM stop
UNION ALL SELECT DISTINCT day, courier, 0, {_LAT}, {_LNG} FROM stop""",
    "route": f"""
SELECT a.day, a.courier, CAST(sqrt(count(*)) AS BIGINT) - 1 AS n,
       list({haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')} ORDER BY a.s, b.s) AS m
FROM point a JOIN point b USING (day, courier) GROUP BY a.day, a.courier""",
    "greedy(day, courier, tour, todo_stops)": f"""
SELECT day, courier, CAST([0] AS BIGINT[]), CAST(range(1, n + 1) AS BIGINT[]) FROM route
UNION ALL
SELECT day, courier, list_append(tour, pick), list_filter(todo_stops, lambda x: x <> pick)
FROM (SELECT g.*, list_min(list_transform(todo_stops, lambda x: {{'km': {_m('g.tour[len(g.tour)]', 'x')}, 'x': x}})).x AS pick
      FROM greedy g JOIN route USING (day, courier) WHERE len(todo_stops) > 0)""",
    "naive": "SELECT day, courier, list_append(tour, 0) AS path FROM greedy WHERE len(todo_stops) = 0",
    # i, j: the segment under test; tick numbers the steps
    "scan(day, courier, path, i, j, changed, tick, done)": f"""
SELECT day, courier, path, 1, 2, false, 0, n < 2 FROM naive JOIN route USING (day, courier)
UNION ALL
SELECT day, courier,
       CASE WHEN better THEN list_concat(path[1:i], list_reverse(path[i + 1:j + 1]), path[j + 2:]) ELSE path END,
       CASE WHEN j < n THEN i WHEN i < n - 1 THEN i + 1 ELSE 1 END,
       CASE WHEN j < n THEN j + 1 WHEN i < n - 1 THEN i + 2 ELSE 2 END,
       CASE WHEN j < n OR i < n - 1 THEN changed OR better ELSE false END,
       tick + 1,
       j >= n AND i >= n - 1 AND NOT (changed OR better)
FROM (SELECT c.*, n, {_m('c.path[i]', 'c.path[i + 1]')} + {_m('c.path[j + 1]', 'c.path[j + 2]')}
        - {_m('c.path[i]', 'c.path[j + 1]')} - {_m('c.path[i + 1]', 'c.path[j + 2]')} > 1e-9 AS better
      FROM scan c JOIN route USING (day, courier) WHERE NOT done)""",
    "tour": """
SELECT s.day, s.courier, r.n, r.m, s.path AS best, v.path AS naive
FROM scan s JOIN route r USING (day, courier) JOIN naive v USING (day, courier) WHERE s.done""",
}


def _assignments(ctes: dict[str, str] = ASSIGN) -> str:
    head = with_ctes(["orders_f", "locations"], "", {k: v for k, v in ctes.items() if "(" not in k}, recursive=True)
    return head.rstrip() + ",\n" + _plain_ctes({k: v for k, v in ctes.items() if "(" in k})


# A month of orders for a fleet of four: the loads pass the capacity and orders spill.
FIXED_FLEET = {
    **ASSIGN,
    "todo": f"SELECT order_id, day // 100 AS day, zone FROM ({DELIVERABLE})",
    "queue": ASSIGN["queue"].replace(
        "greatest(4, CAST(ceil(count(*) OVER (PARTITION BY day) / 10.0) AS BIGINT))", "CAST(4 AS BIGINT)"
    ),
}


def _tours(body: str, more: dict[str, str] | None = None) -> str:
    return f"{_assignments()},\n{_plain_ctes({**TOURS, **(more or {})})}\n{body}"


def _length(path: str) -> str:
    return f"list_sum(list_transform(range(1, n + 2), lambda i: {_m(f'{path}[i]', f'{path}[i + 1]')}))"


SEQUENCE = """
SELECT day, courier, order_id, round(lat, 6) AS lat, round(lng, 6) AS lng, zone,
       CAST(list_position(naive, s) - 1 AS BIGINT) AS naive_pos, CAST(list_position(best, s) - 1 AS BIGINT) AS best_pos
FROM stop JOIN tour USING (day, courier)"""

REPORT = f"""
SELECT day, 'repartidor-' || CAST(courier + 1 AS VARCHAR) AS courier, n AS stops, zones, round(km, 2) AS total_km,
       round(km / CAST(28.0 AS DOUBLE) * 60, 1) AS est_minutes, round(naive_km, 2) AS naive_nn_km,
       CASE WHEN naive_km > 0 THEN round((naive_km - km) * 100 / naive_km, 1) ELSE 0.0 END AS improvement_pct, sequence
FROM (SELECT day, courier, n, {_length('best')} AS km, {_length('naive')} AS naive_km FROM tour)
JOIN (SELECT day, courier, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones,
             string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY list_position(best, s)) AS sequence
      FROM stop JOIN tour USING (day, courier) GROUP BY ALL) USING (day, courier)"""

RETIMED = """
SELECT day, courier, CAST(coalesce(sum(tenths), 0) AS DOUBLE) / 10 AS mesh_minutes
FROM (SELECT day, courier, location_id AS src,
             lead(location_id) OVER (PARTITION BY day, courier ORDER BY list_position(best, s)) AS dst
      FROM stop JOIN tour USING (day, courier)) legs
LEFT JOIN mesh USING (src, dst) GROUP BY ALL"""

SQL = {
    "routing_deliverable": with_ctes(["orders_f", "locations"], DELIVERABLE),
    "routing_assign": _assignments()
    + "\nSELECT order_id, p.day, zone, courier FROM play p JOIN todo USING (order_id) WHERE p.step > 0",
    "routing_assign_fixed": _assignments(FIXED_FLEET)
    + "\nSELECT order_id, p.day AS month, zone, courier FROM play p JOIN todo USING (order_id) WHERE p.step > 0",
    "routing_sequence": _tours(SEQUENCE),
    "routing_report": _tours(REPORT),
    "routing_retimed": _tours(RETIMED, {"mesh": MESH}),
}
