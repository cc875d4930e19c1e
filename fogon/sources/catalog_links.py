"""Catalog tables that follow their lake table.

A registered table is a location in the catalog. Which tables of which database are registered
is noted beside the lake's data, and every write ends by moving their locations to what it
wrote, before older files go. So a table never points to removed files, whichever session
refreshes the lake, as long as both use one catalog.
"""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from fogon.sources.files import exists, read_text, write_text

if TYPE_CHECKING:
    from fogon.sources.lake import Lake


def _note(lake: Lake, zone: str, table: str) -> str:
    return f"{lake.path(zone, table)}/_registered.json"


def registered(lake: Lake, zone: str, table: str) -> list[str]:
    """Databases in which the table is registered."""
    path = _note(lake, zone, table)
    return json.loads(read_text(path)) if exists(path) else []


def register(lake: Lake, zone: str, table: str, database: str) -> str:
    """(Re)create ``database.table`` over the newest version and note it; the table's name."""
    name = f"{database}.{table}"
    spark = lake.spark
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    manifest = lake.manifest(zone, table)
    if manifest is None:
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{lake.current(zone, table)}'")
    else:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lake.open(zone, table, manifest).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{manifest['by']}`) "
            f"LOCATION '{lake.path(zone, table)}'"
        )
        _point(lake, zone, table, name, manifest)
    known = registered(lake, zone, table)
    if database not in known:
        write_text(_note(lake, zone, table), json.dumps([*known, database]))
    return name


def _spec(by: str, value: str) -> str:
    return f"PARTITION (`{by}` = " + ("NULL)" if value == "__HIVE_DEFAULT_PARTITION__" else f"'{value}')")


def _point(lake: Lake, zone: str, table: str, name: str, manifest: dict) -> None:
    """Partitions of the catalog table as the manifest has them."""
    by, spark = manifest["by"], lake.spark
    known = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    for value, version in sorted(manifest["parts"].items()):
        place = lake.part_path(zone, table, by, value, version)
        verb = "SET" if value in known else "ADD"
        if verb == "SET":
            spark.sql(f"ALTER TABLE {name} {_spec(by, value)} SET LOCATION '{place}'")
        else:
            spark.sql(f"ALTER TABLE {name} ADD {_spec(by, value)} LOCATION '{place}'")
    for value in known - set(manifest["parts"]):
        spark.sql(f"ALTER TABLE {name} DROP {_spec(by, value)}")
    spark.catalog.refreshTable(name)


def follow(lake: Lake, zone: str, table: str) -> None:
    """Move the table's catalog entries to its newest version; one that was dropped from the
    catalog stays dropped."""
    for database in registered(lake, zone, table):
        name = f"{database}.{table}"
        if not lake.spark.catalog.tableExists(name):
            continue
        manifest = lake.manifest(zone, table)
        if manifest is None:
            lake.spark.sql(f"ALTER TABLE {name} SET LOCATION '{lake.current(zone, table)}'")
            lake.spark.catalog.refreshTable(name)
        else:
            _point(lake, zone, table, name, manifest)
