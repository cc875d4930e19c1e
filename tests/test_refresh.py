"""Tables kept by month, cubes refreshed from partial states, catalog tables that follow."""

import pytest
from pyspark.sql import functions as F

from fogon.plans import cubes, pipeline
from fogon.schemas import CUBES
from fogon.sources.catalog import register_tables
from fogon.sources.lake import Lake

COLUMNS = (
    "order_id string, date_key int, time_key short, user_key int, location_key int, status_key short, item_count int, "
    "gross_amount decimal(14,2), discount_amount decimal(14,2), net_amount decimal(14,2), delivery_km double, "
    "is_completed boolean, is_cancelled boolean"
)
LINES = "order_id string, date_key int, user_key int, product_key int, status_key short, quantity int, line_amount decimal(14,2)"


def facts(spark, amount=lambda i: 10 + i, n=300):
    """Orders of three months; users recur over months and words, some are unknown."""
    orders, lines = [], []
    for i in range(n):
        day, user, status = 20230101 + 100 * (i % 3) + i % 28, (i * 7) % 150 if i % 11 else None, 2 if i % 7 else 5
        orders.append((f"o{i}", day, i % 24, user, 1 + i % 2, status, 2, amount(i), 0, amount(i), i / 4, status == 2, status == 5))
        lines += [(f"o{i}", day, user, 1 + (i + j) % 5, status, 1 + j, amount(i)) for j in range(3)]
    from decimal import Decimal

    exact = [tuple(Decimal(v) if k in (7, 8, 9) else v for k, v in enumerate(r)) for r in orders]
    return spark.createDataFrame(exact, COLUMNS), spark.createDataFrame([(*r[:6], Decimal(r[6])) for r in lines], LINES)


def dimensions(spark, lake):
    lake.write(spark.createDataFrame(
        [(1, "P1", "C1", "D1", "Z1"), (2, "P2", "C2", "D2", "Z1")],
        "location_key int, province string, canton string, district string, zone string"), "silver", "dim_location")
    lake.write(spark.createDataFrame([(i, f"n{i % 4}", f"c{i % 2}") for i in range(1, 6)],
                                     "product_key int, product_name string, category string"), "silver", "dim_product")
    lake.write(spark.createDataFrame([(2, False), (5, True)], "status_key short, is_cancelled boolean"), "silver", "dim_order_status")


def load(lake, orders, lines):
    for name, df in (("fact_orders", orders), ("fact_order_items", lines)):
        lake.write_changed(df.withColumn("month_key", cubes.month_key()), "gold", name, "month_key")


def rows(tables):
    return {n: sorted(map(str, df.collect())) for n, df in tables.items()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("months")))
    dimensions(spark, lake)
    load(lake, *facts(spark))
    pipeline.refresh_cubes(lake)
    return lake


def direct(lake):
    return cubes.all_cubes(
        lake.read("gold", "fact_orders"), lake.read("gold", "fact_order_items"), lake.read("silver", "dim_location"),
        lake.read("silver", "dim_product"), lake.read("silver", "dim_order_status"),
    )


def parts(lake):
    return {t: lake.manifest("gold", t)["parts"] for t in ("fact_orders", "fact_order_items", *cubes.STATES)}


def test_a_changed_month_rewrites_one_partition_and_equals_a_full_rebuild(spark, made):
    before = parts(made)
    assert all(set(p) == {"202301", "202302", "202303"} for p in before.values())
    assert rows({n: made.read("gold", n) for n in CUBES}) == rows(direct(made))
    pinned = made.read("gold", "fact_orders")
    total = pinned.agg(F.sum("net_amount")).first()[0]
    changed = facts(spark, lambda i: 999 if i == 1 else 10 + i)  # order 1 is of February
    load(made, *changed)
    pipeline.refresh_cubes(made)
    after = parts(made)
    for table in before:
        assert {m for m in before[table] if before[table][m] != after[table][m]} == {"202302"}, table
    assert rows({n: made.read("gold", n) for n in CUBES}) == rows(direct(made))
    # A reader of the version before still reads its files.
    assert pinned.agg(F.sum("net_amount")).first()[0] == total


def test_a_month_that_goes_and_one_that_comes(spark, made):
    orders, lines = facts(spark)
    moved = F.when(F.col("date_key") < 20230200, F.col("date_key") + 400).otherwise(F.col("date_key")).cast("int")
    load(made, orders.withColumn("date_key", moved), lines.withColumn("date_key", moved))
    pipeline.refresh_cubes(made)
    assert all(set(p) == {"202302", "202303", "202305"} for p in parts(made).values())
    assert rows({n: made.read("gold", n) for n in CUBES}) == rows(direct(made))


def test_other_dimensions_make_all_months_anew(spark, made):
    product = made.read("silver", "dim_product").withColumn("category", F.lit("one"))
    made.write(product, "silver", "dim_product")
    before = parts(made)
    pipeline.refresh_cubes(made)
    after = parts(made)
    assert before["fact_orders"] == after["fact_orders"]
    assert not set(before["state_revenue"].values()) & set(after["state_revenue"].values())
    assert rows({n: made.read("gold", n) for n in CUBES}) == rows(direct(made))


def test_nothing_changed_writes_no_state(spark, made):
    before = parts(made)
    pipeline.refresh_cubes(made)
    assert parts(made) == before


def test_a_month_filter_prunes_files(made):
    fact = made.read("gold", "fact_orders")
    plan = fact.where("month_key = 202302").select("net_amount")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "PushedFilters: []" in plan
    only = fact.where("month_key = 202302")
    assert only.count() == only.where("date_key BETWEEN 20230201 AND 20230231").count() > 0


def test_rows_without_a_date_and_old_files(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 7), (None, 8), (2, 9)], "month_key int, v long")
    lake.write_changed(df, "gold", "t", "month_key")
    first = dict(lake.manifest("gold", "t")["parts"])
    assert sorted(lake.read("gold", "t").select("v", "month_key").collect(), key=str) == sorted([(7, 1), (8, None), (9, 2)], key=str)
    for v in (10, 11, 12):
        lake.write_changed(df.withColumn("v", F.when(F.col("month_key") == 2, v).otherwise(F.col("v"))), "gold", "t", "month_key")
    last = lake.manifest("gold", "t")["parts"]
    assert {k for k in first if first[k] != last[k]} == {"2"}
    from fogon.sources.files import exists, folders

    assert not exists(lake.part_path("gold", "t", "month_key", "2", first["2"]))
    assert len(folders(f"{lake.path('gold', 't')}/month_key=2")) == 2
    lake.write_changed(df.limit(0), "gold", "t", "month_key")
    assert lake.read("gold", "t").count() == 0


def test_registered_tables_follow_three_refreshes(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    dimensions(spark, lake)
    load(lake, *facts(spark, n=30))
    lake.write(spark.range(3), "gold", "plain")
    tables = [("gold", "fact_orders"), ("gold", "plain")]
    register_tables(spark, lake, "follow_test", tables)
    for k in range(1, 4):
        load(lake, *facts(spark, lambda i, k=k: 100 * k + i, n=30 + 30 * k))
        lake.write(spark.range(10 * k), "gold", "plain")
        total = spark.sql("SELECT count(*), sum(net_amount) FROM follow_test.fact_orders").first()
        assert tuple(total) == (30 + 30 * k, sum(100 * k + i for i in range(30 + 30 * k)))
        assert spark.table("follow_test.plain").count() == 10 * k
    spark.sql("DROP TABLE follow_test.plain")
    lake.write(spark.range(1), "gold", "plain")
    assert not spark.catalog.tableExists("follow_test.plain")


@pytest.mark.parametrize("kind", ["int", "string"])
def test_bitmaps_count_exactly(spark, kind):
    users = [None if i % 13 == 0 else (i * 37) % 500 - 100 for i in range(900)]
    lines = spark.createDataFrame(
        [(f"o{i}", 20230101 + 100 * (i % 4), u, f"n{i % 3}", f"c{i % 2}", 1, 5.0) for i, u in enumerate(users)],
        "order_id string, date_key int, user_key int, product_name string, category string, quantity bigint, line_amount double",
    ).withColumn("user_key", F.col("user_key").cast(kind))
    got = {(r.grp_flag, r.category, r.product_name, r.month_label): r.distinct_buyers for r in cubes.cube_product_frequency(lines).collect()}
    assert got[7, None, None, None] == len({u for u in users if u is not None})
    for c in range(2):
        assert got[3, f"c{c}", None, None] == len({u for i, u in enumerate(users) if i % 2 == c and u is not None})
        for n in range(3):
            want = {u for i, u in enumerate(users) if i % 2 == c and i % 3 == n and u is not None}
            assert got[1, f"c{c}", f"n{n}", None] == len(want)


def test_a_first_write_runs_its_rows_once(spark, tmp_path, monkeypatch):
    """The fingerprints come from what was written, packed with zstd, and equal those of the rows."""
    import pyarrow.parquet as pq

    from fogon.sources import lake as lakes

    read = []
    own = lakes.fingerprint
    monkeypatch.setattr(lakes, "fingerprint", lambda df, by=None: read.append(df.inputFiles()) or own(df, by))
    lake = lakes.Lake(spark, str(tmp_path / "lake"))
    rows = spark.range(20).selectExpr("CAST(id % 3 AS INT) AS month_key", "id", "CAST(id AS STRING) AS name")
    lake.write_changed(rows, "gold", "t", "month_key")
    assert len(read) == 1 and all("/gold/t/month_key=" in f for f in read[0]) and read[0]
    before = lake.manifest("gold", "t")
    assert before["notes"]["prints"] == own(rows, "month_key")
    lake.write_changed(rows, "gold", "t", "month_key")
    assert lake.manifest("gold", "t")["parts"] == before["parts"]
    path = read[0][0].removeprefix("file://").removeprefix("file:")
    assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"


def test_merged_levels_copy_no_bitmaps(spark, made):
    """Levels merge from one another: no row with a bitmap is expanded into the levels."""
    states = {n: made.read("gold", n) for n in cubes.STATES}
    for name in ("cube_product_frequency", "cube_customer_activity"):
        cube = cubes.from_states(states, [name])[name]
        plan = cube._jdf.queryExecution().optimizedPlan().toString().splitlines()
        expands = [line for line in plan if "Expand [" in line]
        assert expands and not any("bits#" in line for line in expands), name


def test_levels_of_bitmaps_equal_a_plain_count(spark):
    import random

    dice = random.Random(7)
    rows = [(dice.choice([None, "a", "b"]), dice.choice([None, "x", "y", "z"]), dice.choice([202301, 202302, None]),
             dice.choice([None, *range(-70, 200)]), dice.choice([None, 1, 5])) for _ in range(600)]
    words = [(*r[:3], None if r[3] is None else r[3] >> 6, None if r[3] is None else 1 << (r[3] & 63), r[4]) for r in rows]
    signed = [(*r[:4], r[4] - (1 << 64) if r[4] is not None and r[4] >> 63 else r[4], r[5]) for r in words]
    leaf = spark.createDataFrame(signed, "c string, p string, m int, word long, bits long, v long").groupBy("c", "p", "m", "word").agg(
        F.bit_or("bits").alias("bits"), F.sum("v").alias("v"))
    levels = [["c", "p", "m"], ["c", "p"], ["c", "m"], ["c"], []]
    got = cubes._bitmap_levels(leaf, ["c", "p", "m"], levels, "v").collect()
    want = {}
    for flag, level in zip((0, 1, 2, 3, 7), levels):
        for c, p, m, user, v in rows:
            key = tuple(x if d in level else None for d, x in zip("cpm", (c, p, m)))
            users, values = want.setdefault((*key, flag), (set(), []))
            users.update(() if user is None else (user,))
            values += [] if v is None else [v]
    assert len(got) == len(want)
    for r in got:
        users, values = want[r.c, r.p, r.m, r.grp_flag]
        assert (r.users, r.v) == (len(users), sum(values) if values else None)
    assert cubes._bitmap_levels(leaf.limit(0), ["c", "p", "m"], levels, "v").collect() == []


def test_only_distinct_keys_of_an_order_meet(spark, made):
    """Sums of the revenue state are not carried per order; amounts that are unknown stay so."""
    lines = spark.createDataFrame(
        [("o1", 202301, "a", 5, 1), ("o1", 202301, "b", None, 2), ("o2", 202301, "a", 7, 1), ("o2", 202301, "a", 1, None),
         ("o3", 202302, None, 3, 1), ("o3", 202302, "c", None, None)],
        "order_id string, month_key int, category string, revenue_c long, units long")
    state = cubes._revenue_state(lines)
    plan = state._jdf.queryExecution().optimizedPlan().toString().splitlines()
    per_order = [line for line in plan if "Aggregate [order_id#" in line]
    assert per_order and not any("sum(" in line for line in per_order)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in state.select("month_key", "category", "revenue_c", "units", "in_category", "in_total").collect()}
    assert got == {
        (202301, "a"): (13, 2, 2, 2), (202301, "b"): (None, 2, 1, 0),
        (202302, None): (3, 1, 1, 0), (202302, "c"): (0, 0, 1, 1),
    }


def test_files_are_read_in_pieces_of_a_shuffle_partition(spark):
    from fogon.session import tune

    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    tune(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
