"""Facts (bronze + silver -> gold).

Each fact has a ``*_frame`` step (types, date/time keys, status flags; natural ids
still in place, fully lazy) and a keyed step that resolves surrogate keys. Dimension
lookups carry no broadcast hint except for the five-row status table: users and
products grow with the business, so the choice is left to Spark's size check and AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.functions import calendar as cal
from fogon.operators.dense_key import dense_key
from fogon.plans.dims import dim_order_status


def _date_and_hour(df: DataFrame, name: str) -> dict:
    when = cal.local_timestamp(df, name)
    return {"date_key": cal.date_key(when), "time_key": F.hour(when).cast("smallint")}


_ORDER_MEASURES = {
    "item_count": "int",
    "gross_amount": "decimal(14,2)",
    "discount_amount": "decimal(14,2)",
    "net_amount": "decimal(14,2)",
    "delivery_km": "double",
}


def _header(orders: DataFrame, status: DataFrame | None) -> DataFrame:
    status = dim_order_status(orders.sparkSession) if status is None else status
    return orders.withColumns(_date_and_hour(orders, "created_at")).join(
        F.broadcast(status), "status", "left"
    )


def orders_frame(orders: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Order rows with keys of date, time and status; user and location by natural id.

    Source columns a caller left out (location, line count, distance) are left out here.
    """
    keys = ["order_id", "date_key", "time_key", "user_id", "location_id", "status_key"]
    measures = [
        F.col(c).cast(t).alias(c) for c, t in _ORDER_MEASURES.items() if c in orders.columns
    ]
    header = _header(orders, status)
    return header.select(
        *[c for c in keys if c in header.columns], *measures, "is_completed", "is_cancelled"
    )


def order_items_frame(
    order_items: DataFrame, orders: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """Lines with their order's date, time, user, location and status (inner join).

    Two fact tables meet here, so the join is a sort-merge join by order whatever the
    compressed file sizes suggest: it spills, AQE can split a hot order, and later
    steps per order reuse its partitioning.
    """
    wanted = [
        "order_id", "date_key", "time_key", "user_id", "location_id", "status_key", "is_cancelled",
    ]
    header = _header(orders, status)
    header = header.select(*[c for c in wanted if c in header.columns])
    joined = _line_measures(order_items).join(header.hint("merge"), "order_id")
    return joined.select(
        "order_item_id",
        *[c for c in wanted if c in header.columns],
        "product_id", "quantity", "unit_price", "line_amount",
    )


def _line_measures(order_items: DataFrame) -> DataFrame:
    return order_items.select(
        "order_item_id", "order_id", "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("unit_price").cast("decimal(12,2)").alias("unit_price"),
        F.col("line_amount").cast("decimal(14,2)").alias("line_amount"),
    )


def reservations_frame(reservations: DataFrame) -> DataFrame:
    return reservations.select(
        "reservation_id",
        *[
            c.alias(name)
            for name, c in _date_and_hour(reservations, "reserved_at").items()
        ],
        "user_id",
        "location_id",
        F.col("party_size").cast("int").alias("party_size"),
        (F.col("status") == "honored").alias("is_honored"),
        (F.col("status") == "no_show").alias("is_no_show"),
    )


def _resolve(frame: DataFrame, dim: DataFrame, natural: str, key: str) -> DataFrame:
    return frame.join(dim.select(natural, key), natural, "left")


def fact_orders(orders, dim_user, dim_location, dim_status=None) -> DataFrame:
    frame = orders_frame(orders, dim_status)
    frame = _resolve(frame, dim_user, "user_id", "user_key")
    frame = _resolve(frame, dim_location, "location_id", "location_key")
    columns = [
        "order_id", "date_key", "time_key", "user_key", "location_key",
        "status_key", "item_count", "gross_amount", "discount_amount", "net_amount",
        "delivery_km", "is_completed", "is_cancelled",
    ]
    keyed = dense_key(frame.select(*columns), "order_key", ["order_id"], keep=columns)
    return keyed.select("order_key", *columns)


def order_header(orders, dim_user, dim_location, dim_status=None) -> DataFrame:
    """Per order, what its lines take from it, with users and places looked up."""
    header = _resolve(_header(orders, dim_status), dim_user, "user_id", "user_key")
    header = _resolve(header, dim_location, "location_id", "location_key")
    return header.select(*ORDER_HEADER)


ORDER_HEADER = ("order_id", "date_key", "time_key", "user_key", "location_key", "status_key")


def _each_line_once(order_items: DataFrame, header: DataFrame, dim_product: DataFrame) -> bool:
    """Whether every line has exactly one order and at most one product, so that the look-ups
    neither drop nor repeat a line. Lines are reduced to their orders first."""
    products = dim_product.where(F.col("product_id").isNotNull()).groupBy("product_id")
    if products.agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return False
    known = header.groupBy("order_id").agg(F.count("*").alias("n"))
    wanted = order_items.select("order_id").distinct()
    odd = wanted.join(known.hint("merge"), "order_id", "left").where("n IS NULL OR n > 1")
    return odd.limit(1).count() == 0


def fact_order_items(
    order_items, orders, dim_user, dim_product, dim_location, dim_status=None, header=None
) -> DataFrame:
    """Users and places are looked up per order, before the lines meet it (``header``: orders
    that already are, such as the written fact). The natural id is sorted by, not written.

    Where every line has one order and at most one product, lines get their key first: the
    natural id, the widest column, is then shuffled once and only keys and measures go through
    the look-ups. Elsewhere rows are numbered after the look-ups, which drop or repeat them.
    """
    header = (
        order_header(orders, dim_user, dim_location, dim_status) if header is None else header.select(*ORDER_HEADER)
    )
    lines = _line_measures(order_items)
    columns = [
        "order_id", "date_key", "time_key", "user_key", "product_key",
        "location_key", "status_key", "quantity", "unit_price", "line_amount",
    ]
    if _each_line_once(order_items, header, dim_product):
        keep = ["order_id", "product_id", "quantity", "unit_price", "line_amount"]
        keyed = dense_key(lines, "order_item_key", ["order_item_id"], keep=keep)
        keyed = _resolve(keyed, dim_product, "product_id", "product_key").drop("product_id")
        return keyed.join(header.hint("merge"), "order_id").select("order_item_key", *columns)
    lines = _resolve(lines, dim_product, "product_id", "product_key")
    frame = lines.drop("product_id").join(header.hint("merge"), "order_id")
    keyed = dense_key(
        frame.select("order_item_id", *columns), "order_item_key", ["order_item_id"], keep=columns
    )
    return keyed.select("order_item_key", *columns)


def fact_reservations(reservations, dim_user, dim_location) -> DataFrame:
    frame = reservations_frame(reservations)
    frame = _resolve(frame, dim_user, "user_id", "user_key")
    frame = _resolve(frame, dim_location, "location_id", "location_key")
    columns = [
        "reservation_id", "date_key", "time_key", "user_key",
        "location_key", "party_size", "is_honored", "is_no_show",
    ]
    keyed = dense_key(frame.select(*columns), "reservation_key", ["reservation_id"], keep=columns)
    return keyed.select("reservation_key", *columns)
