from __future__ import annotations

from oracle import cubes as c
from oracle.base import with_ctes

REV, ACT, STA = (f"({x})" for x in (c.REVENUE, c.ACTIVITY, c.STATUS))
DATASETS = {
    "rev": f"SELECT month_label, year, quarter_label, category, revenue, units_sold, orders, avg_ticket FROM {REV} WHERE grp_flag = 0",
    "act": f"SELECT zone, province, month_label, active_customers, orders, orders_per_customer, revenue, revenue_per_customer FROM {ACT} WHERE grp_flag = 0",
    "sta": f"SELECT month_label, zone, total_orders, completed, cancelled, cancel_rate_pct, realised_revenue, lost_revenue FROM {STA} WHERE grp_flag = 0",
}
ROLLUPS = f"""
SELECT 'revenue_by_month_category' AS chart, month_label AS x, category AS series, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value FROM rev GROUP BY ALL
UNION ALL SELECT 'total_revenue', NULL, NULL, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) FROM rev
UNION ALL SELECT 'active_customers_by_zone', zone, NULL, CAST(sum(active_customers) AS DOUBLE) FROM act GROUP BY ALL
UNION ALL SELECT 'orders_by_month_zone', month_label, zone, CAST(sum(orders) AS DOUBLE) FROM act GROUP BY ALL
UNION ALL SELECT 'orders_by_zone', zone, NULL, CAST(sum(orders) AS DOUBLE) FROM act GROUP BY ALL
UNION ALL SELECT 'avg_orders_per_customer', zone, NULL, round(avg(orders_per_customer), 4) FROM act GROUP BY ALL
UNION ALL SELECT 'avg_revenue_per_customer', zone, NULL, round(avg(revenue_per_customer), 4) FROM act GROUP BY ALL
UNION ALL SELECT 'completed_by_month', month_label, NULL, CAST(sum(completed) AS DOUBLE) FROM sta GROUP BY ALL
UNION ALL SELECT 'cancelled_by_month', month_label, NULL, CAST(sum(cancelled) AS DOUBLE) FROM sta GROUP BY ALL
UNION ALL SELECT 'avg_cancel_rate_by_month', month_label, NULL, round(avg(cancel_rate_pct), 4) FROM sta GROUP BY ALL
UNION ALL SELECT 'overall_cancel_rate', NULL, NULL, max(cancel_rate_pct) FROM {STA} WHERE grp_flag = 3
"""

SQL = {
    "ds_revenue_by_month_category": with_ctes(["sold"], DATASETS["rev"]),
    "ds_customer_activity_by_zone": with_ctes(["placed"], DATASETS["act"]),
    "ds_orders_completed_vs_cancelled": with_ctes(["placed"], DATASETS["sta"]),
    "ds_peak_hours_heatmap": c.SQL["peak_hours"],
    "ds_overall_cancel_rate": with_ctes(
        ["placed"], f"SELECT total_orders, completed, cancelled, cancel_rate_pct FROM {STA} WHERE grp_flag = 3"
    ),
    "ds_top_peak_hours": with_ctes(
        ["orders_f"],
        f"SELECT day_name, hour, orders FROM ({c.PEAK}) WHERE grp_flag = 0 ORDER BY orders DESC, day_of_week, hour LIMIT 5",
    ),
    "ds_chart_rollups": with_ctes(["sold", "placed"], ROLLUPS, DATASETS),
}
