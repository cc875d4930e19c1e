"""The three analyses: consumption trends, peak hours, monthly growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogon.functions.money import cents, money, ratio_2dp
from fogon.plans.cubes import _month_columns, month_key, revenue_by_order, weekday_hour_leaf


def consumption_trends(items: DataFrame) -> DataFrame:
    """Category x month revenue, units, orders and 3-row moving average of revenue.

    Lines of every status count. An order has one date, so after reducing lines to
    (order, month, category) a plain count of rows is the distinct order count.
    """
    monthly = _month_columns(
        revenue_by_order(items)
        .groupBy("category", "month_key")
        .agg(
            F.sum("revenue_c").alias("revenue_c"),
            F.sum("units").alias("units"),
            F.count("*").alias("orders"),
        )
    )
    # One row per category and month, so a window partition is a handful of rows.
    last3 = Window.partitionBy("category").orderBy("month_key").rowsBetween(-2, 0)
    return (
        monthly.withColumns(
            {
                "sum3": F.sum("revenue_c").over(last3),
                "rows3": F.count("*").over(last3),
            }
        )
        .select(
            "category",
            "month_label",
            "year",
            "month",
            money("revenue_c", 16).alias("revenue"),
            "units",
            "orders",
            ratio_2dp("sum3", "rows3", 16).alias("revenue_ma3"),
        )
        .orderBy("category", "year", "month")
    )


def peak_hours(orders: DataFrame) -> DataFrame:
    """Non-cancelled orders, revenue and average items by ISO weekday and hour."""
    return (
        weekday_hour_leaf(orders)
        .select(
            "day_of_week",
            "day_name",
            "hour",
            "daypart",
            "orders",
            money("revenue_c", 16).alias("revenue"),
            ratio_2dp("items", "counted", 10, times=100).alias("avg_items"),
        )
        .orderBy("day_of_week", "hour")
    )


def monthly_growth(orders: DataFrame) -> DataFrame:
    """Month-over-month growth of non-cancelled revenue and orders, in percent."""
    monthly = _month_columns(
        orders.where(~F.col("is_cancelled") & F.col("date_key").isNotNull())
        .groupBy(month_key())
        .agg(F.sum(cents("net_amount")).alias("revenue_c"), F.count("*").alias("orders"))
    )
    # One row per month of history: the unpartitioned window sees only those.
    by_month = Window.orderBy("month_key")
    prev_c, prev_n = F.col("prev_c"), F.col("prev_orders")
    return (
        monthly.withColumns(
            {
                "prev_c": F.lag("revenue_c").over(by_month),
                "prev_orders": F.lag("orders").over(by_month),
            }
        )
        .select(
            "month_label",
            "year",
            "month",
            money("revenue_c", 16).alias("revenue"),
            "orders",
            money("prev_c", 16).alias("prev_revenue"),
            "prev_orders",
            ratio_2dp(F.col("revenue_c") - prev_c, prev_c, 10, times=10000).alias(
                "revenue_growth_pct"
            ),
            ratio_2dp(F.col("orders") - prev_n, prev_n, 10, times=10000).alias(
                "orders_growth_pct"
            ),
        )
        .orderBy("year", "month")
    )
