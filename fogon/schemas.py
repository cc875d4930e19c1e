"""Column names, order and types of every source and serving table.

Fixed values: these are the table contracts, stated as Spark DDL strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_TABLES = (
    "locations", "categories", "products", "users", "orders", "order_items", "reservations",
)

SOURCE_SCHEMAS = {
    "locations": "location_id string, province string, canton string, district string, "
    "zone string, latitude double, longitude double",
    "categories": "category_id string, name string",
    "products": "product_id string, name string, category string, price decimal(12,2), "
    "is_active boolean",
    "users": "user_id string, full_name string, email string, signup_date date, "
    "location_id string, referred_by string, latitude double, longitude double",
    "orders": "order_id string, user_id string, location_id string, created_at timestamp_ntz, "
    "status string, gross_amount decimal(14,2), discount_amount decimal(14,2), "
    "net_amount decimal(14,2), item_count int, delivery_km double, customer_lat double, "
    "customer_lng double",
    "order_items": "order_item_id string, order_id string, product_id string, quantity int, "
    "unit_price decimal(12,2), line_amount decimal(14,2)",
    "reservations": "reservation_id string, user_id string, location_id string, "
    "reserved_at timestamp_ntz, party_size int, status string",
}

DIMENSIONS = (
    "dim_date", "dim_time", "dim_location", "dim_product", "dim_user", "dim_order_status",
)
FACTS = ("fact_orders", "fact_order_items", "fact_reservations")
ANALYSES = (
    "analysis_consumption_trends", "analysis_peak_hours", "analysis_monthly_growth",
)

CUBES = (
    "cube_revenue_time_category", "cube_sales_by_location", "cube_product_frequency",
    "cube_orders_status", "cube_peak_hours", "cube_customer_activity",
)

SERVING_SCHEMAS = {
    "dim_date": "date_key int, full_date date, year smallint, quarter smallint, "
    "quarter_label string, month smallint, month_name string, month_label string, "
    "day smallint, day_of_week smallint, day_name string, is_weekend boolean",
    "dim_time": "time_key smallint, hour smallint, hour_label string, daypart string",
    "dim_user": "user_key int, user_id string, full_name string, email string, "
    "signup_date date, location_key int",
    "dim_product": "product_key int, product_id string, product_name string, "
    "category string, unit_price decimal(12,2), is_active boolean",
    "dim_location": "location_key int, province string, canton string, district string, "
    "zone string, latitude double, longitude double",
    "dim_order_status": "status_key smallint, status string, is_completed boolean, "
    "is_cancelled boolean",
    "fact_orders": "order_key bigint, order_id string, date_key int, time_key smallint, "
    "user_key int, location_key int, status_key smallint, item_count int, "
    "gross_amount decimal(14,2), discount_amount decimal(14,2), net_amount decimal(14,2), "
    "delivery_km double, is_completed boolean, is_cancelled boolean",
    "fact_order_items": "order_item_key bigint, order_id string, date_key int, "
    "time_key smallint, user_key int, product_key int, location_key int, "
    "status_key smallint, quantity int, unit_price decimal(12,2), line_amount decimal(14,2)",
    "fact_reservations": "reservation_key bigint, reservation_id string, date_key int, "
    "time_key smallint, user_key int, location_key int, party_size int, "
    "is_honored boolean, is_no_show boolean",
    "analysis_consumption_trends": "category string, month_label string, year smallint, "
    "month smallint, revenue decimal(16,2), units bigint, orders bigint, "
    "revenue_ma3 decimal(16,2)",
    "analysis_peak_hours": "day_of_week smallint, day_name string, hour smallint, "
    "daypart string, orders bigint, revenue decimal(16,2), avg_items decimal(10,2)",
    "analysis_monthly_growth": "month_label string, year smallint, month smallint, "
    "revenue decimal(16,2), orders bigint, prev_revenue decimal(16,2), prev_orders bigint, "
    "revenue_growth_pct decimal(10,2), orders_growth_pct decimal(10,2)",
    "cube_revenue_time_category": "year int, quarter_label string, month_label string, "
    "category string, grp_flag int, revenue decimal(18,2), units_sold bigint, orders bigint, "
    "avg_ticket decimal(18,2)",
    "cube_sales_by_location": "province string, canton string, district string, zone string, "
    "grp_flag int, orders bigint, revenue decimal(18,2), units bigint, "
    "avg_order_value decimal(18,2), avg_delivery_km decimal(18,2)",
    "cube_product_frequency": "category string, product_name string, month_label string, "
    "grp_flag int, units_sold bigint, times_ordered bigint, distinct_buyers bigint, "
    "revenue decimal(18,2)",
    "cube_orders_status": "month_label string, zone string, grp_flag int, total_orders bigint, "
    "completed bigint, cancelled bigint, cancel_rate_pct decimal(10,2), "
    "realised_revenue decimal(18,2), lost_revenue decimal(18,2)",
    "cube_peak_hours": "day_of_week int, day_name string, hour int, daypart string, "
    "grp_flag int, orders bigint, revenue decimal(18,2), avg_items decimal(10,2)",
    "cube_customer_activity": "zone string, province string, month_label string, grp_flag int, "
    "active_customers bigint, orders bigint, orders_per_customer decimal(18,2), "
    "revenue decimal(18,2), revenue_per_customer decimal(18,2)",
}

# Columns a warehouse table must not leave NULL; the rest may be empty.
NULLABLE = {
    "dim_user": {"email", "signup_date"},
    "dim_location": {"latitude", "longitude"},
    "fact_orders": {"delivery_km"},
}

PRIMARY_KEYS = {
    "dim_date": ["date_key"],
    "dim_time": ["time_key"],
    "dim_user": ["user_key"],
    "dim_product": ["product_key"],
    "dim_location": ["location_key"],
    "dim_order_status": ["status_key"],
    "fact_orders": ["order_key"],
    "fact_order_items": ["order_item_key"],
    "fact_reservations": ["reservation_key"],
}

UNIQUE_KEYS = {
    "dim_user": ["user_id"],
    "dim_product": ["product_id"],
    "dim_order_status": ["status"],
    "fact_orders": ["order_id"],
    "fact_reservations": ["reservation_id"],
}

# column -> dimension it refers to (dimension key columns carry the same name)
FOREIGN_KEYS = {
    "fact_orders": {
        "date_key": "dim_date", "time_key": "dim_time", "user_key": "dim_user",
        "location_key": "dim_location", "status_key": "dim_order_status",
    },
    "fact_order_items": {
        "date_key": "dim_date", "time_key": "dim_time", "user_key": "dim_user",
        "product_key": "dim_product", "location_key": "dim_location",
        "status_key": "dim_order_status",
    },
    "fact_reservations": {
        "date_key": "dim_date", "time_key": "dim_time", "user_key": "dim_user",
        "location_key": "dim_location",
    },
}


def column_names(table: str) -> list[str]:
    """Serving columns of ``table`` in order (no session needed)."""
    return [column.split()[0] for column in SERVING_SCHEMAS[table].split(", ")]


def required_columns(table: str) -> list[str]:
    return [c for c in column_names(table) if c not in NULLABLE.get(table, set())]


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order columns to the serving contract of ``table``."""
    fields = struct_of(SERVING_SCHEMAS[table]).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
