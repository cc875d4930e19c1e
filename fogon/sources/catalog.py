"""Register lake tables in the session catalog (built-in or Hive)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from fogon.schemas import ANALYSES, CUBES, DIMENSIONS, FACTS
from fogon.sources import catalog_links
from fogon.sources.lake import Lake

REGISTERED = tuple(
    [("silver", t) for t in DIMENSIONS] + [("gold", t) for t in FACTS + ANALYSES + CUBES]
)


def register_tables(
    spark: SparkSession,
    lake: Lake,
    database: str = "order_lake",
    tables: Iterable[tuple[str, str]] = REGISTERED,
) -> list[str]:
    """(Re)create external tables over the lake's Parquet and return their names. Later writes
    of the lake move them along."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    return [catalog_links.register(lake, zone, table, database) for zone, table in tables]
