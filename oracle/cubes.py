from __future__ import annotations

from oracle.base import cents, ratio2, with_ctes

DAY_NAME = (
    "CASE isodow({d}) WHEN 1 THEN 'lunes' WHEN 2 THEN 'martes' WHEN 3 THEN 'miercoles' "
    "WHEN 4 THEN 'jueves' WHEN 5 THEN 'viernes' WHEN 6 THEN 'sabado' WHEN 7 THEN 'domingo' END"
)
DAYPART = (
    "CASE WHEN {h} < 6 THEN 'madrugada' WHEN {h} < 12 THEN 'manana' "
    "WHEN {h} < 18 THEN 'tarde' ELSE 'noche' END"
)

REVENUE = """
SELECT year, quarter_label, month_label, category,
       CAST(grouping(year, quarter_label, month_label, category) AS BIGINT) AS grp_flag,
       CAST(sum(line_amount) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS units_sold,
       count(DISTINCT order_id) AS orders,
       {ratio} AS avg_ticket
FROM (SELECT *, month_key // 100 AS year, 'Q' || CAST((month_key % 100 + 2) // 3 AS VARCHAR) AS quarter_label,
             strftime(created_at, '%Y-%m') AS month_label FROM sold)
GROUP BY GROUPING SETS ((year, quarter_label, month_label, category), (year, quarter_label, month_label),
                        (year, quarter_label), (year), (category), ())
""".format(ratio=ratio2(cents("sum(line_amount)"), "count(DISTINCT order_id)"))

LOCATION = """
SELECT province, canton, district, zone,
       CAST(grouping(province) * 4 + grouping(canton) * 2 + grouping(district) AS BIGINT) AS grp_flag,
       count(*) AS orders, CAST(sum(net_amount) AS DOUBLE) AS revenue,
       CAST(sum(item_count) AS BIGINT) AS units, {aov} AS avg_order_value, {km} AS avg_delivery_km
FROM placed WHERE NOT is_cancelled
GROUP BY GROUPING SETS ((province, canton, district, zone), (province, canton, zone), (province, zone), (zone))
""".format(
    aov=ratio2(cents("sum(net_amount)"), "count(*)"),
    km=ratio2("sum(CAST(round(delivery_km * 1000) AS BIGINT))", "(10 * count(delivery_km))"),
)

FREQUENCY = """
SELECT category, product_name, month_label,
       CAST(grouping(category, product_name, month_label) AS BIGINT) AS grp_flag,
       CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT order_id) AS times_ordered,
       count(DISTINCT user_id) AS distinct_buyers, CAST(sum(line_amount) AS DOUBLE) AS revenue
FROM (SELECT *, strftime(created_at, '%Y-%m') AS month_label FROM sold)
GROUP BY GROUPING SETS ((category, product_name, month_label), (category, product_name),
                        (category, month_label), (category), ())
"""

STATUS = """
SELECT month_label, zone, CAST(grouping(month_label, zone) AS BIGINT) AS grp_flag,
       count(*) AS total_orders, count(*) FILTER (WHERE is_completed) AS completed,
       count(*) FILTER (WHERE is_cancelled) AS cancelled,
       {rate} AS cancel_rate_pct,
       CAST(sum(net_amount) FILTER (WHERE is_completed) AS DOUBLE) AS realised_revenue,
       CAST(sum(gross_amount) FILTER (WHERE is_cancelled) AS DOUBLE) AS lost_revenue
FROM (SELECT *, strftime(created_at, '%Y-%m') AS month_label FROM placed)
GROUP BY CUBE (month_label, zone)
""".format(rate=ratio2("10000 * count(*) FILTER (WHERE is_cancelled)", "count(*)"))

PEAK = """
SELECT day_of_week, day_name, hour, daypart,
       CAST(grouping(day_of_week, hour) AS BIGINT) AS grp_flag, count(*) AS orders,
       CAST(sum(net_amount) AS DOUBLE) AS revenue, {avg} AS avg_items
FROM (SELECT *, CAST(isodow(created_at) AS BIGINT) AS day_of_week, {day} AS day_name,
             time_key AS hour, {part} AS daypart FROM orders_f WHERE NOT is_cancelled)
GROUP BY GROUPING SETS ((day_of_week, day_name, hour, daypart), (hour, daypart), (day_of_week, day_name), (daypart), ())
""".format(
    avg=ratio2("100 * sum(item_count)", "count(*)"),
    day=DAY_NAME.format(d="created_at"),
    part=DAYPART.format(h="time_key"),
)

ACTIVITY = """
SELECT zone, province, month_label, CAST(grouping(zone, province, month_label) AS BIGINT) AS grp_flag,
       count(DISTINCT user_id) AS active_customers, count(*) AS orders,
       {opc} AS orders_per_customer, CAST(sum(net_amount) AS DOUBLE) AS revenue, {rpc} AS revenue_per_customer
FROM (SELECT *, strftime(created_at, '%Y-%m') AS month_label FROM placed WHERE NOT is_cancelled)
GROUP BY GROUPING SETS ((zone, province, month_label), (zone, month_label), (zone), (month_label), ())
""".format(
    opc=ratio2("100 * count(*)", "count(DISTINCT user_id)"),
    rpc=ratio2(cents("sum(net_amount)"), "count(DISTINCT user_id)"),
)

TRENDS = """
SELECT category, month_label, month_key // 100 AS year, month_key % 100 AS month, CAST(rev AS DOUBLE) AS revenue,
       units, orders, {ma} AS revenue_ma3
FROM (SELECT *, sum({c}) OVER w AS sum3, count(*) OVER w AS rows3
      FROM (SELECT p.category, month_key, strftime(created_at, '%Y-%m') AS month_label, sum(line_amount) AS rev,
                   CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) AS orders
            FROM items_f JOIN products p USING (product_id) GROUP BY ALL)
      WINDOW w AS (PARTITION BY category ORDER BY month_key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
""".format(ma=ratio2("sum3", "rows3"), c=cents("rev"))

PEAK_ANALYSIS = """
SELECT day_of_week, day_name, hour, daypart, count(*) AS orders, CAST(sum(net_amount) AS DOUBLE) AS revenue,
       {avg} AS avg_items
FROM (SELECT *, CAST(isodow(created_at) AS BIGINT) AS day_of_week, {day} AS day_name,
             time_key AS hour, {part} AS daypart FROM orders_f WHERE NOT is_cancelled)
GROUP BY ALL
""".format(
    avg=ratio2("100 * sum(item_count)", "count(*)"),
    day=DAY_NAME.format(d="created_at"),
    part=DAYPART.format(h="time_key"),
)

GROWTH = """
SELECT month_label, month_key // 100 AS year, month_key % 100 AS month, CAST(rev AS DOUBLE) AS revenue, orders,
       CAST(prev_rev AS DOUBLE) AS prev_revenue, prev_orders,
       {rg} AS revenue_growth_pct, {og} AS orders_growth_pct
FROM (SELECT *, lag(rev) OVER (ORDER BY month_key) AS prev_rev, lag(orders) OVER (ORDER BY month_key) AS prev_orders
      FROM (SELECT month_key, strftime(created_at, '%Y-%m') AS month_label, sum(net_amount) AS rev, count(*) AS orders
            FROM orders_f WHERE NOT is_cancelled GROUP BY ALL))
""".format(
    rg=ratio2(f"CAST(10000 AS HUGEINT) * ({cents('rev')} - {cents('prev_rev')})", cents("prev_rev")),
    og=ratio2("10000 * (orders - prev_orders)", "prev_orders"),
)

SQL = {
    "cube_revenue_time_category": with_ctes(["sold"], REVENUE),
    "cube_sales_by_location": with_ctes(["placed"], LOCATION),
    "cube_product_frequency": with_ctes(["sold"], FREQUENCY),
    "cube_orders_status": with_ctes(["placed"], STATUS),
    "cube_peak_hours": with_ctes(["orders_f"], PEAK),
    "cube_customer_activity": with_ctes(["placed"], ACTIVITY),
    "consumption_trends": with_ctes(["items_f", "products"], TRENDS),
    "peak_hours": with_ctes(["orders_f"], PEAK_ANALYSIS),
    "monthly_growth": with_ctes(["orders_f"], GROWTH),
}
