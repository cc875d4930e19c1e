"""Shared CTEs: the logical source tables over the TPC-H-like views.

Constants in coordinate formulas are DOUBLE on purpose (bare 9.80 is a decimal in
DuckDB), money is DECIMAL before any sum.
"""

from __future__ import annotations


_HAVERSINE = """
CAST(12742.0 AS DOUBLE) * atan2(
  sqrt(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)
     + cos(radians({lat1})) * cos(radians({lat2}))
     * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2)),
  sqrt(CAST(1.0 AS DOUBLE)
     - (sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)
     + cos(radians({lat1})) * cos(radians({lat2}))
     * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2))))
"""


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return _HAVERSINE.format(lat1=lat1, lng1=lng1, lat2=lat2, lng2=lng2)


KITCHEN = ("CAST(9.9333 AS DOUBLE)", "CAST(-84.0833 AS DOUBLE)")

CTES = {
    "loc_rows": """
SELECT DISTINCT c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
         WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS location_id,
       c_nationkey, c_mktsegment
FROM customer""",
    "locations": """
SELECT location_id, r_name AS province, n_name AS canton, n_name || '/' || c_mktsegment AS district,
       'Z' || CAST(n_nationkey % 4 AS VARCHAR) AS zone,
       CAST(9.80 AS DOUBLE) + CAST((location_id * 37) % 125 AS DOUBLE) / CAST(500.0 AS DOUBLE) AS latitude,
       CAST(-84.40 AS DOUBLE) + CAST((location_id * 53) % 125 AS DOUBLE) / CAST(250.0 AS DOUBLE) AS longitude
FROM loc_rows JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "products": """
SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price
FROM part""",
    "user_rows": """
SELECT *, c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
         WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS location_id,
       CAST((c_custkey * 13) % 41 - 20 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS jitter
FROM customer""",
    "users": """
SELECT c_custkey AS user_id, c_name AS full_name, lower(c_name) || '@example.com' AS email,
       DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup_date, location_id,
       CASE WHEN c_custkey > 0 AND c_custkey % 20 < 7 THEN c_custkey // 2 END AS referred_by,
       CAST(9.80 AS DOUBLE) + CAST((location_id * 37) % 125 AS DOUBLE) / CAST(500.0 AS DOUBLE) + jitter AS latitude,
       CAST(-84.40 AS DOUBLE) + CAST((location_id * 53) % 125 AS DOUBLE) / CAST(250.0 AS DOUBLE) + jitter AS longitude
FROM user_rows""",
    "line_counts": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "order_rows": """
SELECT o_orderkey AS order_id, o_custkey AS user_id, u.location_id,
       o_orderdate + to_hours(CAST((o_orderkey * 7) % 16 + 7 AS INTEGER)) AS created_at,
       CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'completed' END
            WHEN o_orderstatus = 'F' THEN 'delivered'
            WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'preparing' END AS status,
       CAST(o_totalprice AS DECIMAL(14,2)) AS gross_amount,
       CAST(CASE WHEN o_orderkey % 100 < 18
            THEN ((CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) + 5) // 10) / CAST(100 AS DECIMAL(14,2))
            ELSE 0 END AS DECIMAL(14,2)) AS discount_amount,
       CAST(coalesce(n, 0) AS BIGINT) AS item_count,
       u.latitude AS customer_lat, u.longitude AS customer_lng
FROM orders LEFT JOIN users u ON u.user_id = o_custkey LEFT JOIN line_counts ON l_orderkey = o_orderkey""",
    "orders_f": f"""
SELECT order_id, user_id, location_id, created_at, status, gross_amount, discount_amount,
       CAST(gross_amount - discount_amount AS DECIMAL(14,2)) AS net_amount, item_count,
       round({haversine(*KITCHEN, 'customer_lat', 'customer_lng')}, 3) AS delivery_km,
       customer_lat, customer_lng,
       CAST(strftime(created_at, '%Y%m%d') AS BIGINT) AS date_key,
       CAST(strftime(created_at, '%Y%m') AS BIGINT) AS month_key,
       CAST(hour(created_at) AS BIGINT) AS time_key,
       CASE status WHEN 'pending' THEN 1 WHEN 'preparing' THEN 2 WHEN 'delivered' THEN 3
            WHEN 'completed' THEN 4 WHEN 'cancelled' THEN 5 END AS status_key,
       status IN ('delivered', 'completed') AS is_completed, status = 'cancelled' AS is_cancelled
FROM order_rows""",
    "items_f": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, o.user_id, o.location_id, o.date_key, o.month_key,
       o.time_key, o.status_key, o.is_cancelled, o.created_at,
       CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(14,2)) AS line_amount,
       ((2 * CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT) + CAST(l_quantity AS BIGINT))
          // (2 * CAST(l_quantity AS BIGINT))) / CAST(100 AS DOUBLE) AS unit_price,
       l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem JOIN orders_f o ON o.order_id = l_orderkey""",
    "reservations": """
SELECT event_id AS reservation_id, e.user_id, u.location_id, ts AS reserved_at, event_id % 8 + 1 AS party_size,
       CASE event_type WHEN 'purchase' THEN 'honored' WHEN 'error' THEN 'no_show' ELSE 'cancelled' END AS status
FROM events e LEFT JOIN users u ON u.user_id = e.user_id
WHERE event_type IN ('purchase', 'error', 'click')""",
    "sold": """
SELECT i.*, p.category, p.name AS product_name FROM items_f i JOIN products p USING (product_id)
WHERE NOT i.is_cancelled""",
    "placed": """
SELECT o.*, l.province, l.canton, l.district, l.zone FROM orders_f o JOIN locations l USING (location_id)""",
}

# order matters: a CTE may use those above it
_DEPENDS = {
    "locations": ["loc_rows"],
    "users": ["user_rows"],
    "order_rows": ["users", "line_counts"],
    "orders_f": ["order_rows"],
    "items_f": ["orders_f"],
    "reservations": ["users"],
    "sold": ["items_f", "products"],
    "placed": ["orders_f", "locations"],
}


def _closure(names: list[str]) -> list[str]:
    needed: set[str] = set()

    def add(name: str) -> None:
        for parent in _DEPENDS.get(name, []):
            add(parent)
        needed.add(name)

    for name in names:
        add(name)
    return [n for n in CTES if n in needed]


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None, recursive=False) -> str:
    """Prefix ``body`` with the CTEs it needs and its own ``extra`` ones."""
    parts = [f"{n} AS ({CTES[n]})" for n in _closure(names)]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def ratio2(num: str, den: str) -> str:
    """num/den/100 rounded half away from zero to hundredths, exact, as DOUBLE."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE CAST((CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
        f" * ((2 * abs({n}) + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 100 END)"
    )


def cents(x: str) -> str:
    return f"CAST({x} * 100 AS BIGINT)"
