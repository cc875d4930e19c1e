"""Parquet lake: one folder per (zone, table), one folder of it per version.

A version counts once Spark has finished it, so a refresh swaps in a whole new version:
readers never see a gap, frames read before keep their files, and a failed write leaves
the last version in place. The version before the current one is kept for such readers,
older ones are removed.

A table may be kept by month instead (or by any other column of few values). Then each
partition has its own version, and a manifest, written last, names the partitions and
versions that make up the table. A write adds new versions of the partitions it changes and a
new manifest; readers are pinned to the files of the manifest they opened. Files that neither
the newest manifest nor the one before it names are removed.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogon.sources import catalog_links
from fogon.sources.files import delete_file, delete_folder, exists, files, folders, read_text, write_text

ZONES = ("bronze", "silver", "gold")
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def fingerprint(df: DataFrame, by: str | None = None) -> dict[str, list[int]]:
    """Rows and two sums of row hashes, per value of ``by``: what tells equal contents apart
    from changed ones without keeping the rows. A row per value reaches the driver."""
    columns = [F.col(f"`{c}`") for c in df.columns if c != by]
    mark = F.xxhash64(*columns)
    measures = [
        F.count("*").alias("n"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.shiftright(F.xxhash64(F.lit(1), *columns), 24)), F.lit(0)).alias("s"),
    ]
    if by is None:
        return {"": list(df.agg(*measures).first())}
    return {partition_text(r[0]): list(r[1:]) for r in df.groupBy(by).agg(*measures).collect()}


def partition_text(value) -> str:
    return NULL_PARTITION if value is None else str(value)


@dataclass(frozen=True)
class Lake:
    """A lake rooted at ``base`` (default: the ``LAKE_PATH`` variable)."""

    spark: SparkSession
    base: str = ""

    def path(self, zone: str, table: str) -> str:
        if zone not in ZONES:
            raise ValueError(f"unknown zone {zone!r}, expected one of {ZONES}")
        base = self.base or os.getenv("LAKE_PATH")
        if not base:
            raise ValueError("set LAKE_PATH, or pass the lake's base")
        return f"{base.rstrip('/')}/{zone}/{table}"

    def versions(self, zone: str, table: str) -> list[str]:
        """Folders of the finished versions, oldest first."""
        path = self.path(zone, table)
        found = [f"{path}/{v}" for v in folders(path) if v.startswith("v-")]
        return [v for v in found if exists(f"{v}/_SUCCESS")]

    def current(self, zone: str, table: str) -> str:
        """Folder of the newest finished version."""
        found = self.versions(zone, table)
        if not found:
            raise ValueError(f"no version of {zone}.{table} in the lake")
        return found[-1]

    def write(
        self, df: DataFrame, zone: str, table: str, partition_by: Iterable[str] | None = None
    ) -> DataFrame:
        """Write a new version and return it as read back, so later steps start there."""
        version = f"{self.path(zone, table)}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        writer = df.write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(version)
        catalog_links.follow(self, zone, table)
        for old in self.versions(zone, table)[:-2]:
            delete_folder(old)
        return self.spark.read.parquet(version)

    def read(self, zone: str, table: str) -> DataFrame:
        manifest = self.manifest(zone, table)
        return self.open(zone, table, manifest) if manifest else self.spark.read.parquet(self.current(zone, table))

    # ---- tables kept by partition ----------------------------------------------------

    def _manifests(self, zone: str, table: str) -> list[str]:
        path = f"{self.path(zone, table)}/_manifests"
        return [f"{path}/{name}" for name in files(path) if name.endswith(".json")]

    def manifest(self, zone: str, table: str) -> dict | None:
        """The newest manifest: ``by``, ``schema``, ``parts`` (value -> version), ``notes``."""
        found = self._manifests(zone, table)
        return json.loads(read_text(found[-1])) if found else None

    def part_path(self, zone: str, table: str, by: str, value: str, version: str) -> str:
        return f"{self.path(zone, table)}/{by}={value}/version={version}"

    def open(self, zone: str, table: str, manifest: dict) -> DataFrame:
        """The table as one manifest has it. A filter on its partition column prunes files."""
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [self.part_path(zone, table, manifest["by"], k, v) for k, v in sorted(manifest["parts"].items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path(zone, table))
        return reader.parquet(*paths).select(*schema.names)

    def write_parts(
        self, df: DataFrame, zone: str, table: str, by: str, only: Iterable[str] | None = None, notes: dict | None = None,
        printed: bool = False,
    ) -> DataFrame:
        """Write new versions of the partitions of ``df`` and a manifest with them.

        ``only`` names the partitions that are replaced (emptied, where ``df`` has no rows of
        them) while the others stay; without it the table is ``df``. ``printed`` notes the
        fingerprints of the table, taken from the written files.
        """
        old = self.manifest(zone, table) if only is not None else None
        replaced = None if only is None else set(only)
        path, version = self.path(zone, table), f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        columns = [c for c in df.columns if c != by]
        parts = {k: v for k, v in (old["parts"] if old else {}).items() if k not in replaced}
        if replaced is None or replaced:
            # Rows of a partition meet in few files, and a large one is split.
            dealt = df.select(*columns, by).hint("rebalance", F.col(by)).withColumn("version", F.lit(version))
            dealt.write.partitionBy(by, "version").mode("append").parquet(path)
            written = [f.split("=", 1)[1] for f in folders(path) if f.startswith(f"{by}=")]
            parts |= {k: version for k in written if exists(f"{path}/{by}={k}/version={version}")}
        schema = df.select(*columns, by).schema
        body = {"by": by, "schema": json.loads(schema.json()), "parts": parts, "notes": notes or {}}
        if printed:
            body["notes"] = body["notes"] | {"prints": fingerprint(self.open(zone, table, body), by)}
        write_text(f"{path}/_manifests/m-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(body))
        catalog_links.follow(self, zone, table)
        self._tidy(zone, table)
        return self.open(zone, table, body)

    def write_changed(self, df: DataFrame, zone: str, table: str, by: str) -> DataFrame:
        """Like :meth:`write_parts`, for the partitions whose contents differ from what the
        table has. Where the table is there, ``df`` is read twice and should start from a written
        one; a first write runs ``df`` once and takes the fingerprints from what it wrote."""
        old = self.manifest(zone, table)
        if old and old["by"] == by and sorted(f["name"] for f in old["schema"]["fields"]) == sorted(df.columns):
            prints = fingerprint(df, by)
            before = old.get("notes", {}).get("prints", {})
            changed = {k for k in prints if prints[k] != before.get(k)}
            gone = set(old["parts"]) - set(prints)
            text = F.coalesce(F.col(by).cast("string"), F.lit(NULL_PARTITION))
            some = df.where(text.isin(sorted(changed))) if changed < set(prints) else df
            return self.write_parts(some, zone, table, by, changed | gone, {"prints": prints})
        return self.write_parts(df, zone, table, by, printed=True)

    def _tidy(self, zone: str, table: str) -> None:
        found = self._manifests(zone, table)
        kept = [json.loads(read_text(m)) for m in found[-2:]]
        live = {(m["by"], k, v) for m in kept for k, v in m["parts"].items()}
        for name in found[:-2]:
            gone = json.loads(read_text(name))
            for k, v in gone["parts"].items():
                if (gone["by"], k, v) not in live:
                    delete_folder(self.part_path(zone, table, gone["by"], k, v))
            delete_file(name)
