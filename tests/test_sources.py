"""Readers, lake and warehouse options. Nothing here opens a connection."""

import pytest
from pyspark.sql import functions as F

from fogon.schemas import SOURCE_SCHEMAS, SOURCE_TABLES
from fogon.sources import readers, warehouse
from fogon.sources.lake import Lake
from fogon.sources.tpch import TpchSources


def test_csv_source_has_declared_types(spark, sources, tmp_path):
    sources["users"].write.option("header", True).csv(f"{tmp_path}/users.csv")
    users = readers.read_source(spark, "users", "csv", {"path": str(tmp_path)})
    assert users.schema["signup_date"].dataType.simpleString() == "date"
    rows = {r["user_id"]: r for r in users.collect()}
    assert rows["u1"]["referred_by"] is None  # a blank field
    assert rows["u2"]["referred_by"] == "u1"


def test_csv_path_from_environment(spark, sources, tmp_path, monkeypatch):
    sources["categories"].write.option("header", True).csv(f"{tmp_path}/categories.csv")
    monkeypatch.setenv("SOURCE_PATH", str(tmp_path))
    monkeypatch.setenv("SOURCE_KIND", "csv")
    assert readers.read_source(spark, "categories").count() == 2


def test_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError, match="unknown source kind"):
        readers.read_source(spark, "users", "excel")


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("SOURCE_JDBC_URL", "jdbc:postgresql://h/db")
    monkeypatch.setenv("SOURCE_TABLE_ORDERS", "app.pedidos")
    monkeypatch.setenv("SOURCE_USER", "me")
    monkeypatch.setenv("SOURCE_PASSWORD", "secret")
    split = {"partitionColumn": "order_id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    got = readers.jdbc_options("orders", split)
    assert got["dbtable"] == "app.pedidos" and got["url"] == "jdbc:postgresql://h/db"
    assert got["driver"] == "org.postgresql.Driver" and got["user"] == "me"
    assert readers.jdbc_options("users", {"url": "u"})["dbtable"] == "users"
    with pytest.raises(ValueError, match="orders is large"):
        readers.jdbc_options("orders", {})
    monkeypatch.delenv("SOURCE_PASSWORD")
    with pytest.raises(ValueError, match="SOURCE_PASSWORD"):
        readers.jdbc_options("users", {})


def test_jdbc_parallel_read_needs_all_bounds():
    split = {"partitionColumn": "order_id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    login = {"url": "u", "user": "me", "password": "secret"}
    assert readers.jdbc_options("orders", {**login, **split})["numPartitions"] == "4"
    split.pop("upperBound")
    with pytest.raises(ValueError, match="parallel read"):
        readers.jdbc_options("orders", {**login, **split})


def test_mongo_options(monkeypatch):
    monkeypatch.setenv("SOURCE_MONGO_URI", "mongodb://h")
    monkeypatch.setenv("SOURCE_MONGO_DB", "shop")
    got = readers.mongo_options("users", {})
    assert got == {"database": "shop", "collection": "users", "connection.uri": "mongodb://h"}


def test_warehouse_options(monkeypatch):
    monkeypatch.setenv("WAREHOUSE_USER", "w")
    monkeypatch.setenv("WAREHOUSE_PASSWORD", "secret")
    monkeypatch.setenv("WAREHOUSE_JDBC_URL", "jdbc:postgresql://h/db")
    got = warehouse.warehouse_options("fact_orders", {"numPartitions": "16"})
    assert got["dbtable"] == "dw.fact_orders" and got["truncate"] == "true"
    assert got["isolationLevel"] == "NONE" and got["user"] == "w" and got["numPartitions"] == "16"


def test_warehouse_write_goes_to_jdbc(sources, monkeypatch):
    """The writer is configured for JDBC; the save itself is replaced."""
    from pyspark.sql.readwriter import DataFrameWriter

    calls = {}
    monkeypatch.setattr(DataFrameWriter, "format", lambda self, f: calls.update(format=f) or self)
    monkeypatch.setattr(DataFrameWriter, "mode", lambda self, m: calls.update(mode=m) or self)
    monkeypatch.setattr(DataFrameWriter, "save", lambda self: calls.update(saved=True))
    login = {"url": "u", "user": "me", "password": "secret"}
    warehouse.write_warehouse(sources["users"], "dim_user", options=login)
    assert calls == {"format": "jdbc", "mode": "overwrite", "saved": True}


def test_lake_paths_and_partitions(spark, sources, tmp_path):
    lake = Lake(spark, f"{tmp_path}/lake/")
    assert lake.path("silver", "dim_date") == f"{tmp_path}/lake/silver/dim_date"
    with pytest.raises(ValueError):
        lake.path("platinum", "x")
    by_status = lake.write(sources["orders"], "gold", "orders", ["status"])
    assert by_status.count() == 2
    assert list(tmp_path.glob("lake/gold/orders/v-*/status=cancelled"))
    again = lake.write(sources["orders"].limit(1), "gold", "orders", ["status"])
    assert again.count() == 1  # the new version
    assert by_status.count() == 2  # a frame of the version before still reads
    for n in (0, 1, 2):
        lake.write(sources["orders"].limit(n), "gold", "orders")
    assert lake.read("gold", "orders").count() == 2 and len(lake.versions("gold", "orders")) == 2
    (tmp_path / "lake/gold/orders/v-9999").mkdir()  # a write that never finished
    assert lake.read("gold", "orders").count() == 2


def test_lake_path_from_environment(spark, monkeypatch):
    monkeypatch.setenv("LAKE_PATH", "/x/y/")
    assert Lake(spark).path("gold", "t") == "/x/y/gold/t"


@pytest.mark.parametrize("table", SOURCE_TABLES)
def test_adapter_has_every_source_table(spark, table):
    src = TpchSources(spark, "/root/testdata/sf0.001")
    columns = set(src.read(table).columns)
    declared = {c.split()[0] for c in SOURCE_SCHEMAS[table].split(", ")}
    assert declared <= columns


def test_adapter_orders_without_joins(spark):
    plan = (
        TpchSources(spark, "/root/testdata/sf0.001")
        .orders(customer=False, line_count=False)
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    assert "Join" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    src = TpchSources(spark, "/root/testdata/sf0.001")
    df = src.table("orders").where(F.col("o_orderstatus") == "P").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_command_line_options_reach_the_reader(spark, tmp_path, monkeypatch):
    """Options per table, and bounds from a query; the reader itself is replaced."""
    from pyspark.sql.readwriter import DataFrameReader

    from fogon.plans import jobs

    login = ["url=u", "user=me", "password=secret"]
    split = ["orders.partitionColumn=order_id", "orders.numPartitions=4",
             "order_items.partitionColumn=order_item_id", "order_items.numPartitions=8"]
    options = jobs.table_options([*split, *login, "connection.uri=x"])
    assert options["users"] == {"url": "u", "user": "me", "password": "secret", "connection.uri": "x"}
    assert options["orders"]["numPartitions"] == "4" and options["order_items"]["numPartitions"] == "8"
    with pytest.raises(ValueError, match="not an option"):
        jobs.table_options(["orders.numPartitions"])
    seen = []
    monkeypatch.setattr(DataFrameReader, "options", lambda self, **o: seen.append(o) or self)
    monkeypatch.setattr(DataFrameReader, "load", lambda self: spark.createDataFrame([(3, 90)], "low long, high long"))
    lake = Lake(spark, f"{tmp_path}/lake")
    jobs.run_steps(spark, lake, ["extract"], "postgres", [*split, *login])
    queries = [o["query"] for o in seen if "query" in o]
    assert queries == ["SELECT min(order_id) AS low, max(order_id) AS high FROM orders",
                       "SELECT min(order_item_id) AS low, max(order_item_id) AS high FROM order_items"]
    orders = next(o for o in seen if o.get("dbtable") == "orders")
    assert (orders["lowerBound"], orders["upperBound"], orders["numPartitions"]) == ("3", "90", "4")
    assert all("partitionColumn" not in o for o in seen if o.get("dbtable") == "users")


def test_a_running_session_keeps_its_time_zone(spark):
    from fogon.session import get_spark

    before = spark.conf.get("spark.sql.session.timeZone")
    assert get_spark("other").conf.get("spark.sql.session.timeZone") == before
    try:
        assert get_spark("other", time_zone="Asia/Tokyo").conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
