"""Conformed dimensions (bronze -> silver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.functions import calendar as cal
from fogon.operators.dense_key import dense_key

# Order states with their key and the completed / cancelled flags.
ORDER_STATUSES = (
    (1, "pending", False, False),
    (2, "preparing", False, False),
    (3, "delivered", True, False),
    (4, "completed", True, False),
    (5, "cancelled", False, True),
)


def dim_date(orders: DataFrame, reservations: DataFrame) -> DataFrame:
    """One row per date that occurs in orders or reservations.

    Each side is reduced to its distinct dates before the union, so only dates are
    shuffled.
    """
    days = (
        orders.select(cal.local_date(orders, "created_at").alias("full_date"))
        .distinct()
        .union(
            reservations.select(
                cal.local_date(reservations, "reserved_at").alias("full_date")
            ).distinct()
        )
        .where(F.col("full_date").isNotNull())
        .distinct()
    )
    day = F.col("full_date")
    iso_day = cal.iso_weekday(day)
    return days.select(
        cal.date_key(day).alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        cal.quarter_label(F.month(day)).alias("quarter_label"),
        F.month(day).alias("month"),
        cal.month_name(F.month(day)).alias("month_name"),
        cal.month_label(F.year(day), F.month(day)).alias("month_label"),
        F.dayofmonth(day).alias("day"),
        iso_day.alias("day_of_week"),
        cal.day_name(iso_day).alias("day_name"),
        (iso_day >= 6).alias("is_weekend"),
    )


def dim_time(spark: SparkSession) -> DataFrame:
    hour = F.col("id").cast("smallint")
    return spark.range(0, 24, 1, 1).select(
        hour.alias("time_key"),
        hour.alias("hour"),
        cal.hour_label(F.col("id")).alias("hour_label"),
        cal.daypart(hour).alias("daypart"),
    )


def dim_order_status(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({key}, '{name}', {done}, {gone})" for key, name, done, gone in ORDER_STATUSES)
    return spark.sql(
        "SELECT CAST(status_key AS SMALLINT) AS status_key, status, is_completed, is_cancelled "
        f"FROM VALUES {rows} AS t(status_key, status, is_completed, is_cancelled)"
    )


def dim_location(locations: DataFrame) -> DataFrame:
    """Keeps the natural ``location_id`` as a helper; the serving contract drops it."""
    keyed = dense_key(locations, "location_key", ["location_id"], "int")
    return keyed.select(
        "location_key",
        "province",
        "canton",
        "district",
        "zone",
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        "location_id",
    )


def dim_product(products: DataFrame) -> DataFrame:
    return dense_key(products, "product_key", ["product_id"], "int").select(
        "product_key",
        "product_id",
        F.col("name").alias("product_name"),
        "category",
        F.col("price").cast("decimal(12,2)").alias("unit_price"),
        F.col("is_active").cast("boolean").alias("is_active"),
    )


def dim_user(users: DataFrame, dim_location: DataFrame) -> DataFrame:
    return (
        dense_key(users, "user_key", ["user_id"], "int")
        .join(dim_location.select("location_id", "location_key"), "location_id", "left")
        .select(
            "user_key",
            "user_id",
            "full_name",
            "email",
            F.col("signup_date").try_cast("date").alias("signup_date"),
            "location_key",
        )
    )
