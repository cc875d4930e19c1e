from __future__ import annotations

from oracle.base import with_ctes
from oracle.cubes import DAY_NAME, DAYPART

MONTH_NAME = (
    "CASE month(d) WHEN 1 THEN 'enero' WHEN 2 THEN 'febrero' WHEN 3 THEN 'marzo' WHEN 4 THEN 'abril' "
    "WHEN 5 THEN 'mayo' WHEN 6 THEN 'junio' WHEN 7 THEN 'julio' WHEN 8 THEN 'agosto' WHEN 9 THEN 'septiembre' "
    "WHEN 10 THEN 'octubre' WHEN 11 THEN 'noviembre' WHEN 12 THEN 'diciembre' END"
)
LINE_ORDER = (
    "order_id, l_linenumber, product_id, l_suppkey, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)

STAR = {
    "dim_date": f"""
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, strftime(d, '%Y-%m-%d') AS full_date, year(d) AS year,
       quarter(d) AS quarter, 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_label, month(d) AS month,
       {MONTH_NAME} AS month_name, strftime(d, '%Y-%m') AS month_label, day(d) AS day, isodow(d) AS day_of_week,
       {DAY_NAME.format(d='d')} AS day_name, isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(created_at AS DATE) AS d FROM orders_f UNION SELECT CAST(reserved_at AS DATE) FROM reservations)""",
    "dim_time": f"""
SELECT h AS time_key, h AS hour, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS hour_label, {DAYPART.format(h='h')} AS daypart
FROM (SELECT unnest(range(24)) AS h)""",
    "dim_order_status": """
SELECT * FROM (VALUES (1, 'pending', false, false), (2, 'preparing', false, false), (3, 'delivered', true, false),
  (4, 'completed', true, false), (5, 'cancelled', false, true)) AS t(status_key, status, is_completed, is_cancelled)""",
    "dim_location": """
SELECT row_number() OVER (ORDER BY location_id) AS location_key, province, canton, district, zone, latitude, longitude,
       location_id FROM locations""",
    "dim_product": """
SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, name AS product_name, category,
       CAST(price AS DOUBLE) AS unit_price, true AS is_active FROM products""",
    "dim_user": """
SELECT row_number() OVER (ORDER BY user_id) AS user_key, user_id, full_name, email,
       strftime(signup_date, '%Y-%m-%d') AS signup_date, location_key
FROM users LEFT JOIN dim_location USING (location_id)""",
    "fact_orders": """
SELECT row_number() OVER (ORDER BY order_id) AS order_key, order_id, date_key, time_key, user_key, l.location_key,
       status_key, item_count, CAST(gross_amount AS DOUBLE) AS gross_amount,
       CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(net_amount AS DOUBLE) AS net_amount, delivery_km,
       is_completed, is_cancelled
FROM orders_f LEFT JOIN dim_user u USING (user_id) LEFT JOIN dim_location l USING (location_id)""",
    "fact_order_items": f"""
SELECT row_number() OVER (ORDER BY {LINE_ORDER}) AS order_item_key, order_id, date_key, time_key, user_key, product_key,
       l.location_key, status_key, quantity, i.unit_price, CAST(line_amount AS DOUBLE) AS line_amount
FROM items_f i LEFT JOIN dim_user u USING (user_id) LEFT JOIN dim_product p USING (product_id)
LEFT JOIN dim_location l USING (location_id)""",
    "fact_reservations": """
SELECT row_number() OVER (ORDER BY reservation_id) AS reservation_key, reservation_id,
       CAST(strftime(reserved_at, '%Y%m%d') AS BIGINT) AS date_key, CAST(hour(reserved_at) AS BIGINT) AS time_key,
       user_key, l.location_key, party_size, status = 'honored' AS is_honored, status = 'no_show' AS is_no_show
FROM reservations r LEFT JOIN dim_user u USING (user_id) LEFT JOIN dim_location l USING (location_id)""",
}
PARENTS = {
    "dim_user": ["dim_location"],
    "fact_orders": ["dim_location", "dim_user"],
    "fact_order_items": ["dim_location", "dim_user", "dim_product"],
    "fact_reservations": ["dim_location", "dim_user"],
}
NEEDS = {
    "dim_date": ["orders_f", "reservations"],
    "dim_location": ["locations"],
    "dim_product": ["products"],
    "dim_user": ["users", "locations"],
    "fact_orders": ["orders_f", "locations"],
    "fact_order_items": ["items_f", "products", "locations"],
    "fact_reservations": ["reservations", "users", "locations"],
}
ALL_STAR = {name: STAR[name] for name in STAR}
ALL_BASE = ["orders_f", "items_f", "reservations", "products", "locations", "users", "sold", "placed"]


def star(name: str) -> str:
    extra = {p: STAR[p] for p in PARENTS.get(name, [])}
    return with_ctes(NEEDS[name], STAR[name], extra)


def over_star(body: str, more: dict[str, str] | None = None) -> str:
    return with_ctes(ALL_BASE, body, {**ALL_STAR, **(more or {})})


ORDERS_OUT = """
SELECT order_id, user_id, location_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, status,
       CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(discount_amount AS DOUBLE) AS discount_amount,
       CAST(net_amount AS DOUBLE) AS net_amount, item_count, delivery_km, round(customer_lat, 6) AS customer_lat,
       round(customer_lng, 6) AS customer_lng
FROM orders_f"""

BRONZE = """
SELECT 'locations' AS table_name, count(*) AS n_rows FROM locations
UNION ALL SELECT 'categories', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'users', count(*) FROM users
UNION ALL SELECT 'orders', count(*) FROM orders_f UNION ALL SELECT 'order_items', count(*) FROM lineitem
UNION ALL SELECT 'reservations', count(*) FROM reservations"""

SQL = {name: star(name) for name in NEEDS}
SQL |= {
    "dim_time": with_ctes(
        ["orders_f"],
        "SELECT t.*, coalesce(n, 0) AS n_orders FROM dim_time t LEFT JOIN "
        "(SELECT time_key, count(*) AS n FROM orders_f GROUP BY time_key) USING (time_key)",
        {"dim_time": STAR["dim_time"]},
    ),
    "dim_order_status": with_ctes(
        ["orders_f"],
        "SELECT s.*, coalesce(n, 0) AS n_orders FROM dim_order_status s LEFT JOIN "
        "(SELECT status_key, count(*) AS n FROM orders_f GROUP BY status_key) USING (status_key)",
        {"dim_order_status": STAR["dim_order_status"]},
    ),
    "src_csv": with_ctes(["orders_f"], ORDERS_OUT),
    "lake_roundtrip": with_ctes(
        ["orders_f"],
        "SELECT order_id, date_key, time_key, user_id, location_id, status_key, item_count, "
        "CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(discount_amount AS DOUBLE) AS discount_amount, "
        "CAST(net_amount AS DOUBLE) AS net_amount, delivery_km, is_completed, is_cancelled, month_key FROM orders_f",
    ),
    "extract_bronze": with_ctes(["locations", "products", "orders_f", "reservations"], BRONZE),
}
