"""

Only wiring; the work is in ``fogon`` and the DuckDB statements are in ``oracle``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogon.operators.assignment import assign_couriers
from fogon.operators.staging import fresh_dir, stage
from fogon.plans import analyses, cubes, dims, facts, graph, pipeline, quality, routing, serving
from fogon.schemas import CUBES, DIMENSIONS, FACTS
from fogon.session import tune
from fogon.sources.catalog import register_tables
from fogon.sources.lake import Lake
from fogon.sources.readers import read_source
from fogon.sources.tpch import TpchSources


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE, integers as BIGINT and dates as text, so two engines compare."""

    def column(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            return col.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return col.cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(col, "yyyy-MM-dd").alias(field.name)
        return col

    return df.select(*[column(f) for f in df.schema.fields])


def _orders_base(src: TpchSources) -> DataFrame:
    return cubes.orders_base(facts.orders_frame(src.orders()), src.locations(seen=False))


def _bare(src: TpchSources) -> DataFrame:
    return src.orders(customer=False, line_count=False)


def _headers(src: TpchSources) -> DataFrame:
    """Order rows without the customer and line-count joins."""
    return facts.orders_frame(_bare(src))


def _counted(src: TpchSources) -> DataFrame:
    """Order rows with their number of lines."""
    return facts.orders_frame(src.orders(customer=False))


def _items_frame(src: TpchSources) -> DataFrame:
    return facts.order_items_frame(src.order_items(), _bare(src))


def _items_base(src: TpchSources) -> DataFrame:
    return cubes.items_base(_items_frame(src), src.products())


def _revenue(src: TpchSources) -> DataFrame:
    return cubes.cube_revenue_time_category(_items_base(src))


def _activity(src: TpchSources) -> DataFrame:
    return cubes.cube_customer_activity(_orders_base(src))


def _status(src: TpchSources) -> DataFrame:
    return cubes.cube_orders_status(_orders_base(src))


def _chart_rollups(src: TpchSources) -> DataFrame:
    # The cubes are written once, as in a load, and every chart reads them.
    revenue = stage(_revenue(src), "cube-revenue")
    activity = stage(_activity(src), "cube-activity")
    status = stage(_status(src), "cube-status")
    return serving.chart_rollups(
        serving.revenue_by_month_category(revenue),
        serving.customer_activity_by_zone(activity),
        serving.orders_completed_vs_cancelled(status),
        status,
    )


def _mesh(src: TpchSources) -> DataFrame:
    """The route mesh, written once because every relaxation round reads it."""
    return stage(graph.route_mesh(src.locations()), "mesh")


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("route", F.array_join("route", " > "))


# ---- sources, lake, catalog -------------------------------------------------------


def _src_csv(src: TpchSources) -> DataFrame:
    """The orders written as CSV and read back through the CSV source."""
    orders = src.orders()
    base = fresh_dir(src.spark, "csv")
    orders.write.option("header", True).csv(f"{base}/orders.csv")
    back = read_source(src.spark, "orders", "csv", {"path": base}, orders.schema)
    return back.withColumns(
        {
            "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
            "customer_lat": F.round("customer_lat", 6),
            "customer_lng": F.round("customer_lng", 6),
        }
    )


def _new_lake(src: TpchSources) -> Lake:
    return Lake(src.spark, fresh_dir(src.spark, "lake"))


def _lake_roundtrip(src: TpchSources) -> DataFrame:
    frame = facts.orders_frame(src.orders()).withColumn("month_key", cubes.month_key())
    # Ranges of (month, order) keep the files per month few and split a large month.
    spread = frame.repartitionByRange("month_key", "order_id")
    return _new_lake(src).write(spread, "gold", "fact_orders", ["month_key"])


def _extract_bronze(src: TpchSources) -> DataFrame:
    return pipeline.counts(pipeline.extract(src.read, _new_lake(src)))


def _loaded(src: TpchSources, cube_names=(), with_analyses: bool = False) -> Lake:
    """A lake of the query's own, with the star and the tables named."""
    lake = _new_lake(src)
    pipeline.run(src.read, lake, False, with_analyses, cube_names)
    return lake


def _star(lake: Lake) -> dict[str, DataFrame]:
    return {t: lake.read("silver", t) for t in DIMENSIONS} | {t: lake.read("gold", t) for t in FACTS}


def _refresh_cubes(src: TpchSources) -> DataFrame:
    """Rows and revenue per cube and level, from cubes rebuilt on the keyed gold facts."""
    levels = []
    for name, cube in pipeline.refresh_cubes(_loaded(src, CUBES)).items():
        revenue = "realised_revenue" if name == "cube_orders_status" else "revenue"
        levels.append(
            cube.groupBy("grp_flag")
            .agg(F.count("*").alias("n_rows"), F.sum(revenue).alias("revenue"))
            .select(F.lit(name).alias("cube"), "grp_flag", "n_rows", "revenue")
        )
    return reduce(DataFrame.unionByName, levels)


def _load_serving(src: TpchSources) -> DataFrame:
    target = fresh_dir(src.spark, "serving")
    names = pipeline.load_serving(
        _loaded(src, CUBES, True), lambda df, table: df.write.parquet(f"{target}/{table}")
    )
    return pipeline.counts({n: src.spark.read.parquet(f"{target}/{n}") for n in names})


def _catalog_register(src: TpchSources) -> DataFrame:
    names = register_tables(src.spark, _loaded(src, CUBES, True))
    return pipeline.counts({n.split(".")[1]: src.spark.table(n) for n in names})


def _dq_report(src: TpchSources) -> DataFrame:
    lake = _loaded(src, ("cube_revenue_time_category", "cube_orders_status"))
    return quality.report(
        lake.read("gold", "fact_orders"),
        lake.read("gold", "fact_order_items"),
        lake.read("silver", "dim_product"),
        lake.read("gold", "cube_revenue_time_category"),
        lake.read("gold", "cube_orders_status"),
    )


def _not_empty(lake: Lake) -> DataFrame:
    return quality.not_empty(lake.read("gold", "fact_orders"), "fact_orders").unionByName(
        quality.not_empty(lake.read("gold", "fact_order_items"), "fact_order_items")
    )


def _orphans(lake: Lake) -> DataFrame:
    return quality.orphans(
        lake.read("gold", "fact_order_items"), lake.read("silver", "dim_product"), "product_key",
        "order items have a product",
    )


def _one_cube(src: TpchSources, name: str) -> DataFrame:
    return _loaded(src, (name,)).read("gold", name)


def _dq_cube_keys(src: TpchSources) -> DataFrame:
    lake = _loaded(src, CUBES)
    return quality.cube_keys({c: lake.read("gold", c) for c in cubes.CUBE_KEYS})


# ---- dimensions and facts ---------------------------------------------------------


def _dim_user(src: TpchSources) -> DataFrame:
    return dims.dim_user(src.users(), dims.dim_location(src.locations()))


def _used(dim: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """A constant dimension with the number of orders that refer to each row."""
    used = orders.groupBy(key).agg(F.count("*").alias("n"))
    return dim.join(used, key, "left").select(
        *dim.columns, F.coalesce("n", F.lit(0)).alias("n_orders")
    )


def _fact_orders(src: TpchSources) -> DataFrame:
    location = dims.dim_location(src.locations())
    return facts.fact_orders(src.orders(), dims.dim_user(src.users(), location), location)


def _fact_order_items(src: TpchSources) -> DataFrame:
    location = dims.dim_location(src.locations())
    return facts.fact_order_items(
        src.order_items(),
        src.orders(customer=True, line_count=False),
        dims.dim_user(src.users(), location),
        dims.dim_product(src.products()),
        location,
    )


def _fact_reservations(src: TpchSources) -> DataFrame:
    location = dims.dim_location(src.locations())
    return facts.fact_reservations(
        src.reservations(), dims.dim_user(src.users(), location), location
    )


# ---- routing ----------------------------------------------------------------------


def _routing_deliverable(src: TpchSources) -> DataFrame:
    return routing.deliverable(src.orders(line_count=False), src.locations(seen=False)).withColumns(
        {"lat": F.round("lat", 6), "lng": F.round("lng", 6)}
    )


def _routing_assign(src: TpchSources) -> DataFrame:
    return assign_couriers(
        routing.deliverable(src.orders(line_count=False), src.locations(seen=False)).select("order_id", "day", "zone"),
        ["day"],
        grow_fleet=True,
    )


def _routing_assign_fixed(src: TpchSources) -> DataFrame:
    """A month's orders for a fixed fleet: surplus orders go to the least loaded courier."""
    orders = routing.deliverable(src.orders(line_count=False), src.locations(seen=False))
    month = F.call_function("div", F.col("day"), F.lit(100)).alias("month")
    return assign_couriers(orders.select("order_id", month, "zone"), ["month"], grow_fleet=False)


def _routing_stops(src: TpchSources) -> DataFrame:
    return routing.plan_deliveries(src.orders(line_count=False), src.locations(seen=False))


def _routing_sequence(src: TpchSources) -> DataFrame:
    return _routing_stops(src).withColumns(
        {"lat": F.round("lat", 6), "lng": F.round("lng", 6)}
    )


def _routing_report(src: TpchSources) -> DataFrame:
    report = routing.route_report(_routing_stops(src), ["day"])
    return report.withColumns(
        {"zones": F.array_join("zones", ","), "sequence": F.array_join("sequence", ",")}
    )


def _routing_retimed(src: TpchSources) -> DataFrame:
    return routing.retime(_routing_stops(src), ["day"], src.orders(line_count=False), _mesh(src))


# Parameters of the look-up queries.
SEED_PRODUCT = "blue anvil"
KITCHEN_LOCATION, FAR_LOCATION = 0, 124

PLANS: dict[str, Callable[[TpchSources], DataFrame]] = {
    "cube_revenue_time_category": lambda s: cubes.cube_revenue_time_category(_items_base(s)),
    "cube_sales_by_location": lambda s: cubes.cube_sales_by_location(_orders_base(s)),
    "cube_product_frequency": lambda s: cubes.cube_product_frequency(_items_base(s)),
    "cube_orders_status": lambda s: cubes.cube_orders_status(_orders_base(s)),
    "cube_peak_hours": lambda s: cubes.cube_peak_hours(_counted(s)),
    "cube_customer_activity": lambda s: cubes.cube_customer_activity(_orders_base(s)),
    "consumption_trends": lambda s: analyses.consumption_trends(
        cubes.items_with_product(_items_frame(s), s.products())
    ),
    "peak_hours": lambda s: analyses.peak_hours(_counted(s)),
    "monthly_growth": lambda s: analyses.monthly_growth(_headers(s)),
    "ds_revenue_by_month_category": lambda s: serving.revenue_by_month_category(_revenue(s)),
    "ds_customer_activity_by_zone": lambda s: serving.customer_activity_by_zone(_activity(s)),
    "ds_orders_completed_vs_cancelled": lambda s: serving.orders_completed_vs_cancelled(
        _status(s)
    ),
    "ds_peak_hours_heatmap": lambda s: serving.peak_hours_heatmap(
        analyses.peak_hours(_counted(s))
    ),
    "ds_overall_cancel_rate": lambda s: serving.overall_cancel_rate(_status(s)),
    "ds_top_peak_hours": lambda s: serving.top_peak_hours(
        cubes.cube_peak_hours(_counted(s))
    ),
    "ds_chart_rollups": _chart_rollups,
    "graph_nodes": lambda s: graph.node_table(
        s.locations(), s.products(), s.users(), s.orders(line_count=False)
    ),
    "graph_counts": lambda s: graph.node_counts(
        s.locations(), s.products(), s.users(), s.orders(line_count=False)
    ),
    "graph_edges_lives_in": lambda s: graph.lives_in(s.users(), s.locations()),
    "graph_edges_placed": lambda s: graph.placed(_bare(s), s.users()),
    "graph_edges_recommended": lambda s: graph.recommended(s.users()),
    "graph_edges_contains": lambda s: graph.contains(
        s.order_items(), _bare(s), s.products()
    ),
    "graph_edges_route": lambda s: graph.route_mesh(s.locations()).select(
        "src", "dst", "distance_km", "minutes"
    ),
    "copurchase_top_pairs": lambda s: graph.copurchase_top_pairs(s.order_items(), s.products()),
    "also_bought": lambda s: graph.also_bought(s.order_items(), s.products(), SEED_PRODUCT),
    "category_affinity": lambda s: graph.category_affinity(s.order_items(), s.products()),
    "referrers_direct": lambda s: graph.referrers_direct(s.users()),
    "referral_reach": lambda s: graph.referral_reach(s.users()),
    "referral_pagerank": lambda s: graph.referral_pagerank(s.users()),
    "route_shortest_path": lambda s: _as_text(
        graph.route_shortest_path(_mesh(s), s.locations(), KITCHEN_LOCATION, FAR_LOCATION)
    ),
    "route_eta_from_source": lambda s: graph.route_eta_from_source(
        _mesh(s), s.locations(), KITCHEN_LOCATION
    ),
    "route_bounded_path": lambda s: _as_text(
        graph.route_bounded_path(_mesh(s), s.locations(), KITCHEN_LOCATION, FAR_LOCATION)
    ),
    "src_csv": _src_csv,
    "lake_roundtrip": _lake_roundtrip,
    "extract_bronze": _extract_bronze,
    "dim_date": lambda s: dims.dim_date(_bare(s), s.reservations()),
    "dim_time": lambda s: _used(
        dims.dim_time(s.spark), _headers(s), "time_key"
    ),
    "dim_order_status": lambda s: _used(
        dims.dim_order_status(s.spark), _headers(s), "status_key"
    ),
    "dim_location": lambda s: dims.dim_location(s.locations()),
    "dim_product": lambda s: dims.dim_product(s.products()),
    "dim_user": _dim_user,
    "fact_orders": _fact_orders,
    "fact_order_items": _fact_order_items,
    "fact_reservations": _fact_reservations,
    "refresh_cubes": _refresh_cubes,
    "load_serving": _load_serving,
    "catalog_register": _catalog_register,
    "dq_row_counts": lambda s: quality.row_counts(
        {t: df for t, df in _star(_loaded(s)).items() if t in FACTS}
    ),
    "dq_not_empty": lambda s: _not_empty(_loaded(s)),
    "dq_orphans": lambda s: _orphans(_loaded(s)),
    "dq_grand_total": lambda s: quality.grand_total_matches_leaves(
        _one_cube(s, "cube_revenue_time_category")
    ),
    "dq_no_negative": lambda s: quality.no_negative_amounts(
        _loaded(s).read("gold", "fact_orders")
    ),
    "dq_cancel_rate_range": lambda s: quality.cancel_rate_in_range(
        _one_cube(s, "cube_orders_status")
    ),
    "dq_constraints": lambda s: quality.constraints(_star(_loaded(s))),
    "dq_cube_keys": _dq_cube_keys,
    "dq_report": _dq_report,
    "routing_deliverable": _routing_deliverable,
    "routing_assign": _routing_assign,
    "routing_assign_fixed": _routing_assign_fixed,
    "routing_sequence": _routing_sequence,
    "routing_report": _routing_report,
    "routing_retimed": _routing_retimed,
}


def _runner(plan):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(plan(TpchSources(tune(spark), sf_dir)))

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the revenue cube over the smallest test data."""
    return queries()["cube_revenue_time_category"](spark, "/root/testdata/sf0.001")


def _llm():
    """The training-data queries, if their subpackage and what it needs are installed."""
    try:
        from fogon.llm import queries as llm
    except ImportError as missing:
        if not (missing.name or "").startswith(("fogon.llm", "corpus_pipeline")):
            warnings.warn(f"the training-data queries are left out: {missing}", stacklevel=2)
        return None
    return llm


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm = _llm()
    return {name: _runner(plan) for name, plan in PLANS.items()} | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    from oracle import cubes as cube_sql
    from oracle import graph as graph_sql
    from oracle import quality as quality_sql
    from oracle import routing as routing_sql
    from oracle import serving as serving_sql
    from oracle import star as star_sql

    parts = (cube_sql, serving_sql, graph_sql, star_sql, quality_sql, routing_sql)
    llm = _llm()
    return {name: sql for part in parts for name, sql in part.SQL.items()} | (llm.SQL if llm else {})
