"""Command line over the load steps, for spark-submit or a scheduler.

    spark-submit --py-files ... -m fogon.plans.jobs extract dimensions facts analyses cubes check
    python -m fogon.plans.jobs --lake /lake/warehouse --master local[*] all

Options of a source table are given as ``--source-option orders.numPartitions=16`` (of all tables:
without the table), those of the warehouse as ``--sink-option batchsize=5000``. A large table of a
relational source with a ``partitionColumn`` and without bounds gets them from its own smallest
and largest value.

``load`` writes to the JDBC warehouse named by the WAREHOUSE_* variables; ``register``
creates catalog tables; ``graph`` and ``routes`` write gold tables.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import SparkSession

from fogon.plans import graph, pipeline, quality, routing
from fogon.schemas import SOURCE_TABLES
from fogon.session import get_spark
from fogon.sources.catalog import register_tables
from fogon.sources.lake import Lake
from fogon.sources.readers import read_source
from fogon.sources.warehouse import write_warehouse

STEPS = (
    "extract", "dimensions", "facts", "analyses", "cubes", "check", "graph", "routes",
    "load", "register",
)
# "all" leaves out the two steps that need a warehouse or a catalog service.
DEFAULT_STEPS = STEPS[:-2]


def write_graph(lake: Lake) -> pipeline.Tables:
    """Node and edge tables of the property graph, from bronze to gold."""
    src = {t: lake.read("bronze", t) for t in ("locations", "products", "users", "orders")}
    items = lake.read("bronze", "order_items")
    nodes = graph.nodes(src["locations"], src["products"], src["users"], src["orders"])
    tables = {f"graph_node_{label.lower()}": df for label, df in nodes.items()}
    tables |= {
        "graph_edge_lives_in": graph.lives_in(src["users"], src["locations"]),
        "graph_edge_placed": graph.placed(src["orders"], src["users"]),
        "graph_edge_recommended": graph.recommended(src["users"]),
        "graph_edge_contains": graph.contains(items, src["orders"], src["products"]),
        "graph_edge_route": graph.route_mesh(src["locations"]),
    }
    return {name: lake.write(df, "gold", name) for name, df in tables.items()}


def write_routes(lake: Lake) -> pipeline.Tables:
    """Stops and per-courier report of every delivery day."""
    stops = routing.plan_deliveries(lake.read("bronze", "orders"), lake.read("bronze", "locations"))
    written = lake.write(stops, "gold", "route_stops")
    report = lake.write(routing.route_report(written, ["day"]), "gold", "route_report")
    return {"route_stops": written, "route_report": report}


def table_options(given: list[str], tables=SOURCE_TABLES) -> dict[str, dict[str, str]]:
    """``[table.]key=value`` arguments as options per table; a dotted key that starts with no
    table's name (``connection.uri``) is one of all tables."""
    options: dict[str, dict[str, str]] = {t: {} for t in tables}
    for argument in sorted(given, key=lambda a: a.partition("=")[0].partition(".")[0] in tables):
        name, equals, value = argument.partition("=")
        if not equals:
            raise ValueError(f"not an option: {argument!r}, expected [table.]key=value")
        table, _, key = name.partition(".")
        for t in [table] if table in tables and key else tables:
            options[t][key if table in tables and key else name] = value
    return options


def run_steps(
    spark: SparkSession, lake: Lake, steps: list[str], kind: str = "csv",
    source_options: list[str] = (), sink_options: list[str] = (),
) -> None:
    source = table_options(list(source_options))
    sink = dict(o.split("=", 1) for o in sink_options)
    for step in steps:
        if step == "extract":
            written = pipeline.extract(lambda table: read_source(spark, table, kind, source[table]), lake)
        elif step == "dimensions":
            written = pipeline.build_dimensions(lake)
        elif step == "facts":
            written = pipeline.build_facts(lake)
        elif step == "analyses":
            written = pipeline.run_analyses(lake)
        elif step == "cubes":
            written = pipeline.refresh_cubes(lake)
        elif step == "graph":
            written = write_graph(lake)
        elif step == "routes":
            written = write_routes(lake)
        elif step == "check":
            quality.enforce(pipeline.check(lake))
            continue
        elif step == "load":
            pipeline.load_serving(lake, partial(write_warehouse, options=sink) if sink else write_warehouse)
            continue
        else:
            print("[register]", register_tables(spark, lake))
            continue
        for row in pipeline.counts(written).collect():  # one row per table
            print(f"[{step}] {row['table_name']}: {row['n_rows']} rows")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("steps", nargs="+", choices=[*STEPS, "all"])
    parser.add_argument("--lake", default="", help="lake root (default: LAKE_PATH)")
    parser.add_argument("--source-kind", default="csv", choices=["csv", "postgres", "mongo"])
    parser.add_argument("--source-option", action="append", default=[], metavar="[TABLE.]KEY=VALUE")
    parser.add_argument("--sink-option", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--master", default=None)
    parser.add_argument("--jdbc-package", default=None)
    parser.add_argument("--hive-metastore-uri", default=None)
    args = parser.parse_args(argv)
    spark = get_spark(
        "fogon", master=args.master, jdbc_package=args.jdbc_package,
        hive_metastore_uri=args.hive_metastore_uri,
    )
    steps = list(DEFAULT_STEPS) if "all" in args.steps else args.steps
    run_steps(spark, Lake(spark, args.lake), steps, args.source_kind, args.source_option, args.sink_option)


if __name__ == "__main__":
    main()
