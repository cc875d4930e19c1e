"""WARC archives as a PySpark data source (format ``fogon_warc``).

Writing. Each task writes one ``part-*.warc.gz`` of gzip members, a record per member, and
beside it ``part-*.idx``, the members' byte offsets. Files appear under their final name
only when the job commits; what a failed or repeated task wrote is removed.

Reading. Partitions are byte ranges of files, planned from the listing alone: a task finds the
members that begin in its range by a binary search in the index and reads that slice of it,
so no offset passes through the driver. A file without an index is one partition. Equality, IN, null and
prefix filters on ``record_type`` and on header columns are taken over by the source: the
headers of a record are parsed first, and the payload of an unwanted record is neither
inflated (the index says where the next one begins) nor decoded. With option
``payload=false`` no payload is inflated at all. Payloads that are read are checked against
their digest.

Columns read: ``record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to,
payload``; written: the same names, ``payload`` as text. A revisit carries no payload
(null when read); its digest and size describe the full payload.

Defined cases: a null payload is written as the empty one, a null ``target_uri`` or
``refers_to`` as no header (null when read); control characters in a URI are percent-encoded;
an empty table writes no record and reads as no rows.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to string, payload string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in _COLUMNS])
#: Column -> WARC header. The size of a revisited payload is an extension field.
_HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Bytes",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPLIT_BYTES = 32 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return fs, inner.rstrip("/")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record, uncompressed."""
    revisit = row["record_type"] == "revisit"
    block = _HTTP + (b"" if revisit else (row["payload"] or "").encode("utf-8", "surrogatepass"))
    lines = ["WARC/1.1", f"WARC-Date: {date}"]
    for column, header in _HEADERS.items():
        value = row[column]
        if value is not None:
            text = f"sha256:{value}" if column == "payload_digest" else _clean(str(value))
            lines.append(f"{header}: {text}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str
    n: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", "6"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}"
        temporary = f"{folder}/.{uuid.uuid4().hex}"
        at, offsets = 0, []
        with fs.open_output_stream(f"{temporary}.warc.gz", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(row, self.date)) + packer.flush()
                    offsets.append(at)
                    at += len(member)
                    out.write(member)
        with fs.open_output_stream(f"{temporary}.idx", compression=None) as out:
            out.write(np.array([*offsets, at], dtype="<u8").tobytes())
        return _Written(temporary, name, len(offsets))

    def commit(self, messages) -> None:
        fs, folder = _filesystem(self.path)
        for m in messages:
            if m is not None and m.n:
                for end in (".idx", ".warc.gz"):  # the index first: a visible archive has one
                    fs.move(m.temporary + end, m.final + end)
        self.abort([m for m in messages if m is not None and not m.n])

    def abort(self, messages) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                for end in (".idx", ".warc.gz"):
                    fs.delete_file(m.temporary + end)


class _Span(InputPartition):
    """Members that begin at bytes ``first`` to ``last`` (exclusive) of a file."""

    def __init__(self, path: str, first: int, last: int, indexed: bool):
        self.path, self.first, self.last, self.indexed = path, first, last, indexed


def _index_of(archive: str) -> str:
    return archive.removesuffix(".warc.gz") + ".idx"


def _offsets_between(index, first: int, last: int) -> np.ndarray:
    """Offsets of the members that begin in [first, last), and the one where the last of them ends."""

    def at(i: int, n: int = 1) -> np.ndarray:
        index.seek(8 * i)
        return np.frombuffer(index.read(8 * n), dtype="<u8")

    def place(value: int) -> int:
        low, high = 0, index.size() // 8 - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if int(at(middle)[0]) < value else (low, middle)
        return low

    a, b = place(first), place(last)
    return at(a, b - a + 1)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitBytes", _SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Take over filters on headers; yield back the ones Spark has to apply."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith):
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, folder = _filesystem(self.path)
        found = {i.path: i for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))}
        out = []
        for path in sorted(p for p in found if p.endswith(".warc.gz") and not posixpath.basename(p).startswith(".")):
            size = found[path].size
            indexed = _index_of(path) in found
            step = self.split if indexed else max(size, 1)
            out += [_Span(path, at, min(at + step, size), indexed) for at in range(0, size, step)]
        return out or [_Span("", 0, 0, False)]

    def _wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            own = row[name]
            ok = {
                "EqualTo": lambda: own is not None and own == value,
                "EqualNullSafe": lambda: own == value,
                "In": lambda: own is not None and own in value,
                "IsNull": lambda: own is None,
                "IsNotNull": lambda: own is not None,
                "StringStartsWith": lambda: own is not None and str(own).startswith(value),
            }[kind]()
            if not ok:
                return False
        return True

    def read(self, partition: _Span):
        if not partition.path:
            return
        fs, _ = _filesystem(self.path)
        held: list[dict] = []
        size = 0
        offsets = None
        if partition.indexed:
            with fs.open_input_file(_index_of(partition.path)) as index:
                offsets = _offsets_between(index, partition.first, partition.last)
        with fs.open_input_file(partition.path) as file:
            for row in self._records(file, offsets):
                held.append(row)
                size += len(row["payload"] or "")
                if len(held) == 1000 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    def _records(self, file, offsets: np.ndarray | None) -> Iterator[dict]:
        if offsets is None:
            at, end = 0, file.size()
            while at < end:
                member = _Member(file, at, None)
                row = self._row(member)
                at = member.skip()
                if row is not None:
                    yield row
            return
        bounds = offsets.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            row = self._row(_Member(file, a, b))
            if row is not None:
                yield row

    def _row(self, member: _Member) -> dict | None:
        """Headers first; the payload only of a record that passes the filters."""
        fields = dict(
            line.split(": ", 1) for line in member.until(b"\r\n\r\n").decode().split("\r\n")[1:] if ": " in line
        )
        row = {column: fields.get(header) for column, header in _HEADERS.items()} | {"payload": None}
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha256:")
        row["payload_bytes"] = row["payload_bytes"] and int(row["payload_bytes"])
        if not self._wanted(row):
            return None
        if self.payload and row["record_type"] == "response":
            block = member.exactly(int(fields["Content-Length"]))
            raw = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha256(raw).hexdigest() != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} differs from its digest")
            row["payload"] = raw.decode("utf-8", "surrogatepass")
        return row


class _Member:
    """Inflates one gzip member step by step."""

    _STEP = 4096

    def __init__(self, file, first: int, last: int | None):
        self.file, self.at, self.last = file, first, last
        self.inflate, self.held = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        left = self._STEP if self.last is None else min(self._STEP, self.last - self.at)
        self.file.seek(self.at)
        raw = self.file.read(left) if left else b""
        self.at += len(raw)
        self.held += self.inflate.decompress(raw)
        return bool(raw)

    def until(self, mark: bytes) -> bytes:
        while (i := self.held.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record ends before its headers")
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._more():
                raise ValueError("a record ends before its payload")
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self) -> int:
        """Offset behind the member (needs inflating only where there is no index)."""
        while not self.inflate.eof:
            self.held = b""
            if not self._more():
                break
        return self.at - len(self.inflate.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fogon_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark hand it filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def dedup_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records of (page_id, url, html): the smallest id of equal payloads is the response.

    Payloads below ``least`` bytes are never revisits. Only payloads that occur more than
    once enter the look-up table, and it is built by a pre-aggregated group-by, so a payload
    shared by a third of all pages costs one row. Rows that repeat the smallest id are all
    responses. A null id sorts behind every other and is never referred to.
    """
    base = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumns(
        {
            "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
            "payload_bytes": F.octet_length("payload").cast("long"),
        }
    )
    shared = (
        base.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("payload_digest", "first")
    )
    revisit = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = base.join(shared, "payload_digest", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    return marked.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        "payload_bytes",
        F.when(F.col("revisit"), F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def page_id_of(column: str):
    """The page id in a record id of :func:`dedup_records`."""
    return F.regexp_extract(F.col(column), r"^urn:page:(-?\d+)$", 1).try_cast("long")
