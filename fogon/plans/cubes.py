"""Six OLAP cubes: every aggregation level plus ``grp_flag`` in one table.

All cubes follow one shape. The big input is first reduced to the finest level (or
the finest level x the entity that is counted distinctly) with map-side combining;
``Expand`` then multiplies those reduced rows by the number of levels, never the
fact rows. ``grp_flag`` has bit 1 where a column is aggregated away.

Every cube is the merge of a *state*: rows of its finest level with sums, and bitmaps of the
entities counted distinctly. All states carry the month, so a refresh recomputes the states of
the months that changed (:func:`states`) and merges them with the others (:func:`from_states`).

Year, month, weekday and day part are functions of the date and hour keys, so the
date and time dimensions are computed in place instead of joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogon.functions import calendar as cal
from fogon.functions.money import cents, money, ratio_2dp
from fogon.operators.staging import stage
from fogon.plans.dims import dim_order_status
from fogon.schemas import CUBES


def orders_base(fact: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Order rows for the cubes. Joins location by whichever id both sides carry."""
    base = fact.where(F.col("date_key").isNotNull())
    if locations is not None:
        on = "location_key" if "location_key" in fact.columns else "location_id"
        base = base.join(
            locations.select(on, "province", "canton", "district", "zone"), on
        )
    return base


def items_base(
    fact: DataFrame, products: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """Non-cancelled lines with product name and category."""
    status = dim_order_status(fact.sparkSession) if status is None else status
    live = F.broadcast(status.where(~F.col("is_cancelled")).select("status_key"))
    return items_with_product(fact, products).join(live, "status_key", "left_semi")


def items_with_product(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of any status with product name and category."""
    on = "product_key" if "product_key" in fact.columns else "product_id"
    name = "product_name" if "product_name" in products.columns else "name"
    attributes = products.select(on, F.col(name).alias("product_name"), "category")
    return fact.where(F.col("date_key").isNotNull()).join(attributes, on)


def _user_column(base: DataFrame) -> str:
    return "user_key" if "user_key" in base.columns else "user_id"


def _word(base: DataFrame) -> list[Column]:
    """``word`` and ``bits``: users as bitmaps of 64 keys each. Bitmaps of one word merge by OR and
    count exactly, and a level has at most a row per 64 users. A key that is no integer is a
    word of its own. An unknown user has neither."""
    user = _user_column(base)
    if isinstance(base.schema[user].dataType, T.IntegralType):
        key = F.col(user).cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(63)).cast("int"))
        return [F.shiftright(key, 6).alias("word"), bit.alias("bits")]
    return [F.col(user).alias("word"), F.when(F.col(user).isNotNull(), F.lit(1).cast("bigint")).alias("bits")]


def _month_columns(df: DataFrame) -> DataFrame:
    """year, month, quarter_label and month_label from a yyyymm ``month_key``."""
    year = F.call_function("div", F.col("month_key"), F.lit(100)).cast("int")
    month = F.pmod("month_key", F.lit(100)).cast("int")
    return df.withColumns(
        {
            "year": year,
            "month": month,
            "quarter_label": cal.quarter_label(month),
            "month_label": cal.month_label(year, month),
        }
    )


def month_key():
    """yyyymm of ``date_key``: the integer the big group-bys use instead of labels."""
    return F.call_function("div", F.col("date_key"), F.lit(100)).cast("int").alias("month_key")


def revenue_by_order(items: DataFrame) -> DataFrame:
    """Lines reduced to (order, month, category) with cents and units."""
    return items.groupBy("order_id", month_key(), "category").agg(
        F.sum(cents("line_amount")).alias("revenue_c"),
        F.sum("quantity").alias("units"),
    )


def _first(*partition: str, order: list[str]):
    """1 on one row per partition, else 0: sums to the number of distinct partitions."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return (F.row_number().over(window) == 1).cast("bigint")


def cube_revenue_time_category(items: DataFrame) -> DataFrame:
    """Revenue, units, distinct orders and average ticket by time x category.

    An order has one date, so distinct orders need no distinct aggregate: a level with
    category counts (order, category) rows, one without counts each order on its first
    category only. Both are plain sums, so all levels come from the month x category
    leaf table. The window sees at most one row per category of an order.
    """
    return _revenue_levels(
        revenue_by_order(items)
        .withColumn("first", _first("order_id", order=["category"]))
        .groupBy("month_key", "category")
        .agg(
            F.sum("revenue_c").alias("revenue_c"),
            F.sum("units").alias("units"),
            F.count("*").alias("in_category"),
            F.sum("first").alias("in_total"),
        )
    )


def _revenue_levels(state: DataFrame) -> DataFrame:
    leaf = _month_columns(state)
    dims = ["year", "quarter_label", "month_label", "category"]
    y, q, m, c = (F.col(d) for d in dims)
    levels = leaf.groupingSets([[y, q, m, c], [y, q, m], [y, q], [y], [c], []], y, q, m, c).agg(
        F.grouping_id(*dims).cast("int").alias("grp_flag"),
        F.sum("revenue_c").alias("revenue_c"),
        F.sum("units").alias("units_sold"),
        F.when(F.grouping("category") == 0, F.sum("in_category"))
        .otherwise(F.sum("in_total"))
        .alias("orders"),
    )
    return levels.select(
        *dims,
        "grp_flag",
        money("revenue_c").alias("revenue"),
        "units_sold",
        "orders",
        ratio_2dp("revenue_c", "orders").alias("avg_ticket"),
    )


def cube_sales_by_location(orders: DataFrame) -> DataFrame:
    """Sales by ROLLUP(province, canton, district), each crossed with zone.

    Zone is part of every level, so the coarsest level is one row per zone and there
    is no grand total row.
    """
    return _location_levels(_location_state(orders))


_GEO = ["province", "canton", "district"]


def _location_state(orders: DataFrame, *more: Column) -> DataFrame:
    # Distances are metres as integers: their sum does not depend on row order.
    metres = F.round(F.col("delivery_km") * 1000).cast("bigint")
    return orders.where(~F.col("is_cancelled")).groupBy(*more, *_GEO, "zone").agg(
        F.count("*").alias("orders"),
        F.sum(cents("net_amount")).alias("revenue_c"),
        F.sum(F.col("item_count").cast("bigint")).alias("units"),
        F.sum(metres).alias("metres"),
        F.count("delivery_km").alias("measured"),
    )


def _location_levels(leaf: DataFrame) -> DataFrame:
    geo = _GEO
    p, c, d, z = (F.col(x) for x in [*geo, "zone"])
    levels = leaf.groupingSets([[p, c, d, z], [p, c, z], [p, z], [z]], p, c, d, z).agg(
        (F.grouping("province") * 4 + F.grouping("canton") * 2 + F.grouping("district"))
        .cast("int")
        .alias("grp_flag"),
        *[
            F.sum(x).alias(x)
            for x in ("orders", "revenue_c", "units", "metres", "measured")
        ],
    )
    return levels.select(
        *geo,
        "zone",
        "grp_flag",
        "orders",
        money("revenue_c").alias("revenue"),
        "units",
        ratio_2dp("revenue_c", "orders").alias("avg_order_value"),
        ratio_2dp("metres", F.col("measured") * 10).alias("avg_delivery_km"),
    )


def _bitmap_levels(leaf: DataFrame, dims: list[str], levels: list[list[str]], *measures: str) -> DataFrame:
    """``dims``, ``grp_flag``, ``users`` and ``measures`` of every level of a leaf with bitmaps.

    The leaf has one row per group of the first level, which names all ``dims``, and word: its bits
    are counted where they lie, and measures add up from that level. Only the bitmaps of the other
    levels are merged by OR, each from the last finer level before it, so no row is copied per level.
    """
    bit_count = F.sum(F.bit_count("bits")).alias("users")
    base = leaf.groupBy(*dims).agg(bit_count, *[F.sum(m).alias(m) for m in measures])
    keys = [F.col(d) for d in dims]
    sums = base.groupingSets([[F.col(d) for d in level] for level in levels], *keys).agg(
        F.grouping_id(*dims).cast("int").alias("grp_flag"), F.sum("users").alias("users"),
        *[F.sum(m).alias(m) for m in measures],
    )
    # Users of the first level add up in no other one.
    parts = [sums.withColumn("users", F.when(F.col("grp_flag") == 0, F.col("users")))]
    merged = [leaf]
    for k, level in enumerate(levels[1:], 1):
        source = next(merged[i] for i in reversed(range(k)) if set(level) <= set(levels[i]))
        merged.append(source.groupBy(*level, "word").agg(F.bit_or("bits").alias("bits")))
        flag = sum(1 << i for i, d in enumerate(reversed(dims)) if d not in level)
        parts.append(
            # Grouped by the flag too: the level without columns has no row where the leaf has none.
            merged[k].groupBy(*level, F.lit(flag).alias("grp_flag")).agg(bit_count).select(
                *[F.col(d) if d in level else F.lit(None).cast(leaf.schema[d].dataType).alias(d) for d in dims],
                "grp_flag", "users",
                *[F.lit(None).cast(base.schema[m].dataType).alias(m) for m in measures],
            )
        )
    return reduce(DataFrame.unionByName, parts).groupBy(*dims, "grp_flag").agg(
        F.coalesce(F.sum("users"), F.lit(0)).cast("bigint").alias("users"),
        *[F.sum(m).alias(m) for m in measures],
    )


def _product_lines(items: DataFrame) -> DataFrame:
    """Lines as (order, month, category, product name) with the buyer's bit, written once. An
    order has one month and one buyer."""
    bare = items.select(
        "order_id", month_key(), "category", "product_name", *_word(items),
        cents("line_amount").alias("revenue_c"), "quantity",
    )
    return stage(
        bare.groupBy("order_id", "month_key", "category", "product_name").agg(
            F.min("word").alias("word"), F.min("bits").alias("bits"),
            F.sum("revenue_c").alias("revenue_c"), F.sum("quantity").alias("units"),
        ),
        "product-lines",
    )


def _product_state(lines: DataFrame) -> DataFrame:
    return lines.groupBy("month_key", "category", "product_name", "word").agg(
        F.bit_or("bits").alias("bits"), F.count("*").alias("times"),
        F.sum("units").alias("units"), F.sum("revenue_c").alias("revenue_c"),
    )


def _revenue_state(lines: DataFrame) -> DataFrame:
    """Sums and distinct orders by (month, category). An order counts in each of its
    categories, and in the smallest one for the levels without category. Sums add up where the
    lines lie; only the distinct (order, month, category) meet in shuffles."""
    zero, sums = F.lit(0).cast("bigint"), ["revenue_c", "units"]
    own = lines.groupBy("month_key", "category").agg(*[F.sum(m).alias(m) for m in sums])
    by_order = lines.select("order_id", "month_key", "category").distinct()
    per_category = by_order.groupBy("month_key", "category").agg(F.count("*").alias("in_category"))
    whole = by_order.groupBy("order_id", "month_key").agg(F.min("category").alias("category"))
    per_order = whole.groupBy("month_key", "category").agg(
        *[F.max(zero).alias(m) for m in (*sums, "in_category")], F.count("*").alias("in_total")
    )
    both = own.withColumn("in_total", zero).unionByName(per_category, allowMissingColumns=True)
    both = both.unionByName(per_order, allowMissingColumns=True)
    return both.groupBy("month_key", "category").agg(
        *[F.sum(m).alias(m) for m in (*sums, "in_category", "in_total")]
    )


def cube_product_frequency(items: DataFrame) -> DataFrame:
    """Units, distinct orders, distinct buyers and revenue by category/product/month.

    The lines are joined once, reduced to (order, product name) and written. Buyers recur over
    months and products, so each level merges the bitmaps of a finer one and counts the bits;
    unknown buyers are in none. Orders are counted from (order, category). No step orders or
    gathers the rows of an order, and all are combined map-side.
    """
    lines = _product_lines(items)
    return _product_levels(_product_state(lines), _revenue_state(lines))


def _product_levels(leaf: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders``: the state of the revenue cube, for the levels above the product."""
    dims = ["category", "product_name", "month_key"]
    c, p, m = dims
    sales = _bitmap_levels(leaf, dims, [[c, p, m], [c, p], [c, m], [c], []], "times", "units", "revenue_c")
    # Above the product an order's lines meet: distinct orders are those of the revenue cube,
    # where an order is in its smallest category for the level without one.
    counted = orders.groupingSets([[F.col(c), F.col(m)], [F.col(c)], []], F.col(c), F.col(m)).agg(
        F.grouping_id(c, m).alias("level"), F.sum("in_category").alias("in_category"), F.sum("in_total").alias("in_total")
    )
    level = F.when(F.col("level") == 0, 2).when(F.col("level") == 1, 3).otherwise(7)
    none = F.lit(None).cast("bigint")
    ordered = counted.select(
        c, F.lit(None).cast("string").alias(p), m, level.alias("grp_flag"), none.alias("users"),
        F.when(F.col("level") == 3, F.col("in_total")).otherwise(F.col("in_category")).alias("times"),
        none.alias("units"), none.alias("revenue_c"),
    )
    own = sales.withColumn("times", F.when(F.col("grp_flag") < 2, F.col("times")))
    both = own.unionByName(ordered).groupBy(*dims, "grp_flag").agg(
        *[F.sum(x).alias(x) for x in ("units", "times", "users", "revenue_c")]
    )
    return _month_columns(both).select(
        c, p, "month_label", "grp_flag",
        F.col("units").alias("units_sold"),
        F.col("times").alias("times_ordered"),
        F.col("users").alias("distinct_buyers"),
        money("revenue_c").alias("revenue"),
    )


def cube_orders_status(orders: DataFrame) -> DataFrame:
    """CUBE(month, zone) over all orders: completed against cancelled."""
    return _status_levels(_status_state(orders))


def _status_state(orders: DataFrame) -> DataFrame:
    return orders.groupBy(month_key(), "zone").agg(
        F.count("*").alias("total_orders"),
        F.count_if("is_completed").alias("completed"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.sum(F.when(F.col("is_completed"), cents("net_amount"))).alias("realised_c"),
        F.sum(F.when(F.col("is_cancelled"), cents("gross_amount"))).alias("lost_c"),
    )


def _status_levels(state: DataFrame) -> DataFrame:
    leaf = _month_columns(state)
    measures = ["total_orders", "completed", "cancelled", "realised_c", "lost_c"]
    levels = leaf.cube("month_label", "zone").agg(
        F.grouping_id("month_label", "zone").cast("int").alias("grp_flag"),
        *[F.sum(x).alias(x) for x in measures],
    )
    return levels.select(
        "month_label",
        "zone",
        "grp_flag",
        "total_orders",
        "completed",
        "cancelled",
        ratio_2dp("cancelled", "total_orders", 10, times=10000).alias("cancel_rate_pct"),
        money("realised_c").alias("realised_revenue"),
        money("lost_c").alias("lost_revenue"),
    )


def weekday_hour_leaf(orders: DataFrame) -> DataFrame:
    """Non-cancelled orders by ISO weekday and hour, with names."""
    return _named_hours(_hour_state(orders))


def _hour_state(orders: DataFrame, *more: Column) -> DataFrame:
    iso_day = cal.iso_weekday(cal.date_of_key(F.col("date_key")))
    return (
        orders.where(~F.col("is_cancelled") & F.col("time_key").isNotNull())
        .groupBy(
            *more, iso_day.cast("int").alias("day_of_week"), F.col("time_key").cast("int").alias("hour")
        )
        .agg(
            F.count("*").alias("orders"),
            F.sum(cents("net_amount")).alias("revenue_c"),
            F.sum(F.col("item_count").cast("bigint")).alias("items"),
            F.count("item_count").alias("counted"),
        )
    )


def _named_hours(leaf: DataFrame) -> DataFrame:
    return leaf.withColumns(
        {"day_name": cal.day_name(F.col("day_of_week")), "daypart": cal.daypart(F.col("hour"))}
    )


def cube_peak_hours(orders: DataFrame) -> DataFrame:
    """Orders by weekday x hour.

    ``grp_flag`` covers weekday and hour only, so level 3 holds the day-part rows and
    the grand total; ``daypart IS NULL`` marks the latter.
    """
    return _hour_levels(_hour_state(orders))


def _hour_levels(leaf: DataFrame) -> DataFrame:
    dims = ["day_of_week", "day_name", "hour", "daypart"]
    w, n, h, d = (F.col(x) for x in dims)
    levels = (
        _named_hours(leaf)
        .groupingSets([[w, n, h, d], [h, d], [w, n], [d], []], w, n, h, d)
        .agg(
            (F.grouping("day_of_week") * 2 + F.grouping("hour")).cast("int").alias("grp_flag"),
            *[F.sum(x).alias(x) for x in ("orders", "revenue_c", "items", "counted")],
        )
    )
    return levels.select(
        *dims,
        "grp_flag",
        "orders",
        money("revenue_c").alias("revenue"),
        ratio_2dp("items", "counted", 10, times=100).alias("avg_items"),
    )


def cube_customer_activity(orders: DataFrame) -> DataFrame:
    """Active customers, orders and revenue by zone/province/month."""
    return _activity_levels(_activity_state(orders))


def _activity_state(orders: DataFrame) -> DataFrame:
    live = orders.where(~F.col("is_cancelled")).select(
        "zone", "province", month_key(), *_word(orders), cents("net_amount").alias("revenue_c")
    )
    return live.groupBy("month_key", "zone", "province", "word").agg(
        F.bit_or("bits").alias("bits"), F.count("*").alias("orders"), F.sum("revenue_c").alias("revenue_c")
    )


def _activity_levels(leaf: DataFrame) -> DataFrame:
    z, p, m = dims = ["zone", "province", "month_key"]
    levels = _bitmap_levels(leaf, dims, [[z, p, m], [z, m], [z], [m], []], "orders", "revenue_c")
    return _month_columns(levels).select(
        z, p, "month_label", "grp_flag",
        F.col("users").alias("active_customers"),
        "orders",
        ratio_2dp("orders", "users", times=100).alias("orders_per_customer"),
        money("revenue_c").alias("revenue"),
        ratio_2dp("revenue_c", "users").alias("revenue_per_customer"),
    )


# Columns that identify a cube row; checked by the data-quality job.
CUBE_KEYS = {
    "cube_revenue_time_category": ["year", "quarter_label", "month_label", "category", "grp_flag"],
    "cube_sales_by_location": ["province", "canton", "district", "zone", "grp_flag"],
    "cube_product_frequency": ["category", "product_name", "month_label", "grp_flag"],
    "cube_orders_status": ["month_label", "zone", "grp_flag"],
    "cube_peak_hours": ["day_of_week", "hour", "daypart", "grp_flag"],
    "cube_customer_activity": ["zone", "province", "month_label", "grp_flag"],
}


def all_cubes(
    orders_fact: DataFrame,
    items_fact: DataFrame,
    locations: DataFrame,
    products: DataFrame,
    status: DataFrame | None = None,
    names=CUBES,
) -> dict[str, DataFrame]:
    """The named cubes over one pair of facts (keyed gold tables or lazy frames)."""
    orders = orders_base(orders_fact, locations)
    items = items_base(items_fact, products, status)
    build = {
        "cube_revenue_time_category": lambda: cube_revenue_time_category(items),
        "cube_sales_by_location": lambda: cube_sales_by_location(orders),
        "cube_product_frequency": lambda: cube_product_frequency(items),
        "cube_orders_status": lambda: cube_orders_status(orders),
        "cube_peak_hours": lambda: cube_peak_hours(orders_base(orders_fact)),
        "cube_customer_activity": lambda: cube_customer_activity(orders),
    }
    return {name: build[name]() for name in names}


#: State table of each cube, and the fact it comes from.
STATES = {
    "state_revenue": "fact_order_items",
    "state_products": "fact_order_items",
    "state_location": "fact_orders",
    "state_status": "fact_orders",
    "state_hours": "fact_orders",
    "state_activity": "fact_orders",
}

_CUBE_STATES = {
    "cube_revenue_time_category": ("state_revenue",),
    "cube_sales_by_location": ("state_location",),
    "cube_product_frequency": ("state_products", "state_revenue"),
    "cube_orders_status": ("state_status",),
    "cube_peak_hours": ("state_hours",),
    "cube_customer_activity": ("state_activity",),
}
_LEVELS = {
    "cube_revenue_time_category": _revenue_levels,
    "cube_sales_by_location": _location_levels,
    "cube_product_frequency": _product_levels,
    "cube_orders_status": _status_levels,
    "cube_peak_hours": _hour_levels,
    "cube_customer_activity": _activity_levels,
}


def states_of(names=CUBES) -> list[str]:
    """State tables that the named cubes merge."""
    wanted = {s for n in names for s in _CUBE_STATES[n]}
    return [s for s in STATES if s in wanted]


def states(
    orders_fact: DataFrame | None,
    items_fact: DataFrame | None,
    locations: DataFrame,
    products: DataFrame,
    status: DataFrame | None = None,
    names=tuple(STATES),
) -> dict[str, DataFrame]:
    """The named states of the facts given (of all months, or of some); each has ``month_key``
    and one month's rows depend on that month's facts alone."""
    orders = None if orders_fact is None else orders_base(orders_fact, locations)
    lines = None
    if {"state_revenue", "state_products"} & set(names):
        items = items_base(items_fact, products, status)
        # Only the product state needs the products of an order.
        lines = _product_lines(items) if "state_products" in names else stage(revenue_by_order(items), "order-categories")
    build = {
        "state_revenue": lambda: _revenue_state(lines),
        "state_products": lambda: _product_state(lines),
        "state_location": lambda: _location_state(orders, month_key()),
        "state_status": lambda: _status_state(orders),
        "state_hours": lambda: _hour_state(orders_base(orders_fact), month_key()),
        "state_activity": lambda: _activity_state(orders),
    }
    return {name: build[name]() for name in names}


def from_states(state: dict[str, DataFrame], names=CUBES) -> dict[str, DataFrame]:
    """The named cubes, merged from the states of all months."""
    return {name: _LEVELS[name](*[state[s] for s in _CUBE_STATES[name]]) for name in names}
