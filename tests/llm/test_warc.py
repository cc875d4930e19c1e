"""WARC archives: the query, the standard's form, pushed filters, splits and hard cases."""

import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F
from tests.compare import compare, duck

from fogon.llm import queries, warc
from fogon.operators.staging import fresh_dir


def test_query_equals_the_statement(spark):
    sf_dir = "/root/testdata/sf0.01"
    equal, message = compare(spark, duck(sf_dir), sf_dir, "op8", queries.op8_warc, queries.OP8_SQL)
    assert equal, message


LONG = "<p>" + "é" * 120
ROWS = [
    (3, "http://a/x", LONG), (2, "http://b\r\nEvil: 1", LONG), (2, "u", LONG), (9, None, LONG), (None, "n", LONG), (4, "v", "short"),
    (5, "v", "short"), (6, "w", None), (7, "w", ""), (8, "t", "WARC/1.1\r\n\r\n" * 20_000), (1, "s", "x" * 99), (10, "s", "x" * 99),
]


@pytest.fixture(scope="module")
def archive(spark):
    warc.register(spark)
    path = fresh_dir(spark, "warc")
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    warc.dedup_records(pages).write.format("fogon_warc").mode("append").save(path)
    return path


def folder(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_rows_come_back(spark, archive):
    rows = spark.read.format("fogon_warc").load(archive).collect()
    assert len(rows) == len(ROWS)
    kinds = sorted((r.record_id.split(":")[-1], r.record_type, r.refers_to) for r in rows if r.payload_bytes > 200 and r.payload_bytes < 1000)
    two = "urn:page:2"
    assert kinds == [("2", "response", None), ("2", "response", None), ("3", "revisit", two), ("9", "revisit", two), ("none", "revisit", two)]
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload.encode()).hexdigest() == r.payload_digest
            assert len(r.payload.encode()) == r.payload_bytes
        else:
            assert r.payload is None and r.payload_digest == hashlib.sha256(LONG.encode()).hexdigest()
    assert {r.target_uri for r in rows} >= {"http://b%0D%0AEvil: 1", None}


def test_files_are_gzip_members_with_headers(archive):
    names = os.listdir(folder(archive))
    assert all(re.fullmatch(r"part-\d+\.(warc\.gz|idx)", n) for n in names if not n.endswith(".crc")), names
    text = b"".join(gzip.open(f"{folder(archive)}/{n}").read() for n in names if n.endswith(".gz"))
    assert text.count(b"WARC-Record-ID: ") == len(ROWS) and b"WARC-Type: revisit\r\n" in text


@pytest.mark.parametrize(
    "condition",
    [
        "record_type = 'revisit'", "record_type IN ('response', 'x')", "target_uri IS NULL", "target_uri LIKE 'http://%'",
        "refers_to = 'urn:page:2'", "record_type = 'response' AND payload_bytes > 99", "payload LIKE '%short%'",
        "payload_bytes = 5", "record_type <=> 'revisit' OR target_uri = 'v'", "refers_to IS NOT NULL",
    ],
)
def test_filters(spark, archive, condition):
    frame = spark.read.format("fogon_warc").load(archive)
    want = sorted(map(str, frame.withColumn("keep", F.expr(condition)).collect()))
    got = frame.where(condition).withColumn("keep", F.lit(True)).collect()
    assert sorted(map(str, got)) == [w for w in want if "keep=True" in w]


def test_header_filters_are_taken_over():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader({"path": "x"})
    kept = [EqualTo(("payload",), "x"), GreaterThan(("payload_bytes",), 5)]
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("target_uri",), "h"), *kept])) == kept


def test_unwanted_payloads_are_not_inflated(spark, archive, monkeypatch):
    reader = warc.WarcReader({"path": archive, "payload": "false"})
    monkeypatch.setattr(warc._Member, "exactly", lambda *a: pytest.fail("a payload was read"))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(ROWS) and all(r["payload"] is None for r in rows)


def test_splits_and_a_lost_index(spark, archive):
    whole = sorted(map(str, spark.read.format("fogon_warc").load(archive).collect()))
    split = spark.read.format("fogon_warc").option("splitBytes", "300").load(archive)
    assert split.rdd.getNumPartitions() > 5
    assert sorted(map(str, split.collect())) == whole
    reader = warc.WarcReader({"path": archive})
    got = [str(r) for n in os.listdir(folder(archive)) if n.endswith(".gz")
           for b in reader.read(warc._Span(f"{folder(archive)}/{n}", 0, 0, False)) for r in b.to_pylist()]
    assert len(got) == len(whole)


def test_damaged_payload_is_noticed(spark, tmp_path):
    row = {"record_id": "urn:page:1", "record_type": "response", "target_uri": None, "payload_digest": "0" * 64,
           "payload_bytes": 1, "refers_to": None, "payload": "x"}
    (tmp_path / "part-0.warc.gz").write_bytes(gzip.compress(warc.record_bytes(row, "1970-01-01T00:00:00Z")))
    reader = warc.WarcReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="digest"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_empty_table(spark):
    path = fresh_dir(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.dedup_records(pages).write.format("fogon_warc").mode("append").save(path)
    assert spark.read.format("fogon_warc").load(path).collect() == []


def test_partitions_come_from_the_listing_alone(spark, tmp_path):
    """Spans are few bytes whatever the number of records; together they read every record once."""
    import io
    import pickle

    import numpy as np

    from fogon.llm import warc

    warc.register(spark)
    rows = [(f"urn:page:{i}", f"text {i} " * (1 + i % 50)) for i in range(3000)]
    frame = warc.dedup_records(
        spark.createDataFrame([(i, None, t) for i, (_, t) in enumerate(rows)], "page_id long, url string, html string")
    )
    path = str(tmp_path / "archive")
    frame.coalesce(1).write.format("fogon_warc").mode("append").option("path", path).save()
    for split in (1, 777, 5000, 1 << 25):
        spans = warc.WarcReader({"path": path, "splitBytes": str(max(split, 300))}).partitions()
        assert max(len(pickle.dumps(s)) for s in spans) < 1000
    back = spark.read.format("fogon_warc").option("path", path).option("splitBytes", "5000").load()
    assert sorted(r.record_id for r in back.select("record_id").collect()) == sorted(i for i, _ in rows)

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    offsets = [0, 5, 9, 30, 31, 64]
    file = File(np.array(offsets, dtype="<u8").tobytes())
    for step in range(1, 70):
        starts = []
        for a in range(0, 64, step):
            got = warc._offsets_between(file, a, min(a + step, 64)).tolist()
            starts += got[:-1]
        assert starts == offsets[:-1]
