"""JDBC sink for the serving warehouse."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from fogon.sources.readers import required


def warehouse_options(table: str, options: Mapping[str, str] | None = None) -> dict[str, str]:
    """Writer options: overwrite keeps the table (TRUNCATE), no transaction isolation."""
    resolved = {
        "driver": "org.postgresql.Driver",
        "dbtable": f"dw.{table}",
        "truncate": "true",
        "cascadeTruncate": "true",
        "isolationLevel": "NONE",
        "batchsize": "10000",
        **(options or {}),
    }
    for option, variable in (
        ("url", "WAREHOUSE_JDBC_URL"), ("user", "WAREHOUSE_USER"), ("password", "WAREHOUSE_PASSWORD")
    ):
        if option not in resolved:
            resolved[option] = required(variable)
    return resolved


def write_warehouse(
    df: DataFrame, table: str, mode: str = "overwrite", options: Mapping[str, str] | None = None
) -> None:
    """Write one table; ``numPartitions`` in the options bounds the connections."""
    df.write.format("jdbc").options(**warehouse_options(table, options)).mode(mode).save()
