"""Source readers: one function, the kind of source is a parameter."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fogon.schemas import SOURCE_SCHEMAS

SOURCE_KINDS = ("csv", "postgres", "mongo")
#: Tables that a relational source must read over several connections.
LARGE_TABLES = ("orders", "order_items")


def required(variable: str) -> str:
    """The environment variable, or an error that names it; there are no default places."""
    value = os.getenv(variable)
    if not value:
        raise ValueError(f"set {variable}, or pass the option")
    return value


def read_source(
    spark: SparkSession,
    table: str,
    kind: str | None = None,
    options: Mapping[str, str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read one source table.

    ``kind`` and the options fall back to the environment (``SOURCE_KIND``,
    ``SOURCE_PATH``, ``SOURCE_JDBC_URL``, ``SOURCE_TABLE_<NAME>``, ``SOURCE_USER``,
    ``SOURCE_PASSWORD``, ``SOURCE_MONGO_URI``, ``SOURCE_MONGO_DB``).
    """
    kind = kind or os.getenv("SOURCE_KIND", "csv")
    options = dict(options or {})
    if kind == "csv":
        return read_csv(spark, table, options, schema)
    if kind == "postgres":
        return read_jdbc(spark, table, options)
    if kind == "mongo":
        return read_mongo(spark, table, options)
    raise ValueError(f"unknown source kind {kind!r}, expected one of {SOURCE_KINDS}")


def read_csv(spark, table, options, schema=None) -> DataFrame:
    """CSV with a header and a declared schema, so no pass over the data to infer one.

    A directory ``<path>/<table>.csv`` of part files reads in parallel like one file.
    """
    base = options.pop("path", None) or required("SOURCE_PATH")
    return (
        spark.read.schema(schema or SOURCE_SCHEMAS[table])
        .option("header", True)
        .options(**options)
        .csv(f"{base.rstrip('/')}/{table}.csv")
    )


def jdbc_options(table: str, options: Mapping[str, str], empty: bool = False) -> dict[str, str]:
    """Reader options for a relational source.

    Pass ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` to read a
    large table over several connections; without them Spark uses one.
    """
    resolved = {
        "dbtable": os.getenv(f"SOURCE_TABLE_{table.upper()}", table),
        "driver": "org.postgresql.Driver",
        "fetchsize": "10000",
        **options,
    }
    for option, variable in (
        ("url", "SOURCE_JDBC_URL"), ("user", "SOURCE_USER"), ("password", "SOURCE_PASSWORD")
    ):
        if option not in resolved:
            resolved[option] = required(variable)
    split = {"partitionColumn", "lowerBound", "upperBound"}
    given = split & resolved.keys()
    if given and (given != split or "numPartitions" not in resolved):
        raise ValueError(f"a parallel read needs {sorted(split)} and numPartitions")
    if table in LARGE_TABLES and not given and not empty and "query" not in resolved:
        raise ValueError(
            f"{table} is large: pass {sorted(split)} and numPartitions, one connection does not scale"
        )
    return resolved


def bounds_query(table: str, options: Mapping[str, str]) -> dict[str, str]:
    """Reader options of the query for the smallest and largest partition value of a table."""
    column = options["partitionColumn"]
    split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions", "dbtable"}
    rest = {k: v for k, v in options.items() if k not in split}
    name = options.get("dbtable") or os.getenv(f"SOURCE_TABLE_{table.upper()}", table)
    return {**rest, "query": f"SELECT min({column}) AS low, max({column}) AS high FROM {name}"}


def read_jdbc(spark, table, options) -> DataFrame:
    """One connection, or with a ``partitionColumn`` and ``numPartitions`` several; bounds that
    are not given come from a query of the database."""
    if "partitionColumn" in options and "numPartitions" in options and not {"lowerBound", "upperBound"} & set(options):
        query = jdbc_options(table, bounds_query(table, options))
        query.pop("dbtable", None)
        low, high = spark.read.format("jdbc").options(**query).load().first()
        if low is None:  # an empty table
            options = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}
            return spark.read.format("jdbc").options(**jdbc_options(table, options, empty=True)).load()
        options = {**options, "lowerBound": str(low), "upperBound": str(high)}
    return spark.read.format("jdbc").options(**jdbc_options(table, options)).load()


def mongo_options(table: str, options: Mapping[str, str]) -> dict[str, str]:
    resolved = {"collection": table, **options}
    for option, variable in (("database", "SOURCE_MONGO_DB"), ("connection.uri", "SOURCE_MONGO_URI")):
        if option not in resolved:
            resolved[option] = required(variable)
    return resolved


def read_mongo(spark, table, options) -> DataFrame:
    """Needs the MongoDB Spark connector on the classpath."""
    return spark.read.format("mongodb").options(**mongo_options(table, options)).load()
