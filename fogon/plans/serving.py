"""Datasets the dashboards read: leaf levels, big numbers and chart roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def revenue_by_month_category(cube_revenue: DataFrame) -> DataFrame:
    return (
        cube_revenue.where("grp_flag = 0")
        .select(
            "month_label", "year", "quarter_label", "category", "revenue", "units_sold",
            "orders", "avg_ticket",
        )
        .orderBy("month_label", "category")
    )


def customer_activity_by_zone(cube_activity: DataFrame) -> DataFrame:
    return (
        cube_activity.where("grp_flag = 0")
        .select(
            "zone", "province", "month_label", "active_customers", "orders",
            "orders_per_customer", "revenue", "revenue_per_customer",
        )
        .orderBy("zone", "month_label", "province")
    )


def orders_completed_vs_cancelled(cube_status: DataFrame) -> DataFrame:
    return (
        cube_status.where("grp_flag = 0")
        .select(
            "month_label", "zone", "total_orders", "completed", "cancelled",
            "cancel_rate_pct", "realised_revenue", "lost_revenue",
        )
        .orderBy("month_label", "zone")
    )


def peak_hours_heatmap(peak_hours: DataFrame) -> DataFrame:
    return peak_hours.select(
        "day_of_week", "day_name", "hour", "daypart", "orders", "revenue", "avg_items"
    ).orderBy("day_of_week", "hour")


def overall_cancel_rate(cube_status: DataFrame) -> DataFrame:
    return cube_status.where("grp_flag = 3").select(
        "total_orders", "completed", "cancelled", "cancel_rate_pct"
    )


def top_peak_hours(cube_peak: DataFrame, k: int = 5) -> DataFrame:
    """Busiest weekday/hour cells; equal counts are ordered by weekday and hour."""
    return (
        cube_peak.where("grp_flag = 0")
        .orderBy(F.desc("orders"), "day_of_week", "hour")
        .limit(k)
        .select("day_name", "hour", "orders")
    )


def _chart(df: DataFrame, chart: str, x: str | None, series: str | None, value) -> DataFrame:
    keys = [F.col(c).alias(n) for c, n in ((x, "x"), (series, "series")) if c]
    out = df.groupBy(*keys).agg(value.cast("double").alias("value"))
    for name in ("x", "series"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(F.lit(chart).alias("chart"), "x", "series", "value")


def chart_rollups(
    revenue_ds: DataFrame, activity_ds: DataFrame, status_ds: DataFrame, status_cube: DataFrame
) -> DataFrame:
    """The metric behind each dashboard chart as (chart, x, series, value) rows.

    Summing active customers over months counts a customer once per month; that is
    the chart's definition, not a distinct count.
    """
    charts = [
        _chart(revenue_ds, "revenue_by_month_category", "month_label", "category",
               F.sum("revenue")),
        _chart(revenue_ds, "total_revenue", None, None, F.sum("revenue")),
        _chart(activity_ds, "active_customers_by_zone", "zone", None,
               F.sum("active_customers")),
        _chart(activity_ds, "orders_by_month_zone", "month_label", "zone", F.sum("orders")),
        _chart(activity_ds, "orders_by_zone", "zone", None, F.sum("orders")),
        _chart(activity_ds, "avg_orders_per_customer", "zone", None,
               F.round(F.avg("orders_per_customer"), 4)),
        _chart(activity_ds, "avg_revenue_per_customer", "zone", None,
               F.round(F.avg("revenue_per_customer"), 4)),
        _chart(status_ds, "completed_by_month", "month_label", None, F.sum("completed")),
        _chart(status_ds, "cancelled_by_month", "month_label", None, F.sum("cancelled")),
        _chart(status_ds, "avg_cancel_rate_by_month", "month_label", None,
               F.round(F.avg("cancel_rate_pct"), 4)),
        _chart(status_cube.where("grp_flag = 3"), "overall_cancel_rate", None, None,
               F.max("cancel_rate_pct")),
    ]
    out = charts[0]
    for chart in charts[1:]:
        out = out.unionByName(chart)
    return out
