"""Dimensions and facts on hand-made rows, and the distributed key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fogon.operators.dense_key import dense_key, range_positions
from fogon.plans import dims, facts
from fogon.schemas import SERVING_SCHEMAS, conform, struct_of


def star(sources):
    location = dims.dim_location(sources["locations"])
    user = dims.dim_user(sources["users"], location)
    product = dims.dim_product(sources["products"])
    return location, user, product


def test_dim_date_keys_and_names(sources):
    rows = {
        r["date_key"]: r
        for r in dims.dim_date(sources["orders"], sources["reservations"]).collect()
    }
    assert set(rows) == {20230804, 20230806, 20230809, 20230810}
    friday, sunday = rows[20230804], rows[20230806]
    assert friday["month_name"] == "agosto" and friday["month_label"] == "2023-08"
    assert friday["quarter_label"] == "Q3" and friday["quarter"] == 3
    assert (friday["day_of_week"], friday["day_name"], friday["is_weekend"]) == (5, "viernes", False)
    assert (sunday["day_of_week"], sunday["day_name"], sunday["is_weekend"]) == (7, "domingo", True)


def test_dim_date_skips_text_that_is_no_date(spark, sources):
    bad = sources["orders"].withColumn("created_at", F.lit("not a date"))
    keys = [r["date_key"] for r in dims.dim_date(bad, sources["reservations"]).collect()]
    assert sorted(keys) == [20230809, 20230810]


def test_text_with_an_offset_is_an_instant(spark):
    from fogon.functions.calendar import local_timestamp

    texts = ["2024-03-01T23:30:00-06:00", "2024-03-01 23:30:00", "2024-03-01T23:30:00Z", "2024-03-01", "soon", None]
    frame = spark.createDataFrame([(t,) for t in texts], "at string")
    got = [str(r[0]) for r in frame.select(local_timestamp(frame, "at")).collect()]
    assert got == ["2024-03-02 05:30:00", "2024-03-01 23:30:00", "2024-03-01 23:30:00", "2024-03-01 00:00:00", "None", "None"]


def test_dim_time_has_24_hours_and_four_dayparts(spark):
    rows = {r["hour"]: r for r in dims.dim_time(spark).collect()}
    assert sorted(rows) == list(range(24))
    assert {h: rows[h]["daypart"] for h in (5, 6, 11, 12, 17, 18)} == {
        5: "madrugada", 6: "manana", 11: "manana", 12: "tarde", 17: "tarde", 18: "noche",
    }
    assert rows[7]["hour_label"] == "07:00"


def test_dim_order_status_flags(spark):
    rows = {r["status"]: (r["is_completed"], r["is_cancelled"]) for r in dims.dim_order_status(spark).collect()}
    assert rows == {
        "pending": (False, False), "preparing": (False, False), "delivered": (True, False),
        "completed": (True, False), "cancelled": (False, True),
    }


def test_dim_user_resolves_location_key(sources):
    _, user, _ = star(sources)
    rows = {r["user_id"]: r for r in user.collect()}
    assert len(rows) == 3
    assert rows["u1"]["location_key"] == 1 and rows["u2"]["location_key"] == 2
    assert str(rows["u1"]["signup_date"]) == "2023-05-04"


def test_dim_user_keeps_unknown_location_as_null(sources):
    location = dims.dim_location(sources["locations"].where("location_id = 'north'"))
    rows = {r["user_id"]: r["location_key"] for r in dims.dim_user(sources["users"], location).collect()}
    assert rows == {"u1": 1, "u2": None, "u3": None}


def test_fact_order_items_resolves_keys_and_amounts(sources):
    location, user, product = star(sources)
    rows = facts.fact_order_items(
        sources["order_items"], sources["orders"], user, product, location
    ).collect()
    assert len(rows) == 3
    assert all(r["product_key"] and r["user_key"] and r["location_key"] for r in rows)
    assert {r["date_key"] for r in rows} == {20230804, 20230806}
    assert sum(r["line_amount"] for r in rows) == 5200
    assert sorted(r["order_item_key"] for r in rows) == [1, 2, 3]


def test_fact_order_items_drops_lines_without_order(sources):
    location, user, product = star(sources)
    one = sources["orders"].where("order_id = 'o1'")
    rows = facts.fact_order_items(sources["order_items"], one, user, product, location).collect()
    assert {r["order_id"] for r in rows} == {"o1"}


def test_fact_orders_flags(sources):
    location, user, _ = star(sources)
    rows = {r["order_id"]: r for r in facts.fact_orders(sources["orders"], user, location).collect()}
    assert rows["o1"]["is_completed"] and not rows["o1"]["is_cancelled"]
    assert rows["o2"]["is_cancelled"] and not rows["o2"]["is_completed"]
    assert (rows["o1"]["date_key"], rows["o1"]["time_key"]) == (20230804, 13)


def test_fact_reservations_flags(sources):
    location, user, _ = star(sources)
    rows = {
        r["reservation_id"]: r
        for r in facts.fact_reservations(sources["reservations"], user, location).collect()
    }
    assert (rows["r1"]["is_honored"], rows["r1"]["is_no_show"]) == (True, False)
    assert (rows["r2"]["is_honored"], rows["r2"]["is_no_show"]) == (False, True)
    assert rows["r2"]["time_key"] == 12


def test_conform_gives_the_serving_contract(spark, sources):
    location, user, product = star(sources)
    built = {
        "dim_location": location,
        "dim_user": user,
        "dim_product": product,
        "dim_time": dims.dim_time(spark),
        "dim_order_status": dims.dim_order_status(spark),
        "dim_date": dims.dim_date(sources["orders"], sources["reservations"]),
        "fact_orders": facts.fact_orders(sources["orders"], user, location),
    }
    for name, df in built.items():
        got = [(f.name, f.dataType) for f in conform(df, name).schema.fields]
        want = [(f.name, f.dataType) for f in struct_of(SERVING_SCHEMAS[name]).fields]
        assert got == want, name


def test_dense_key_equals_global_row_number(spark):
    rows = spark.range(5000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("natural"), F.col("id")
    )
    keyed = dense_key(rows.repartition(7), "k", ["natural"])
    wanted = rows.withColumn("w", F.row_number().over(Window.orderBy("natural")))
    both = keyed.join(wanted.select("natural", "w"), "natural")
    assert both.where("k <> w").isEmpty()
    assert both.count() == 5000


def test_dense_key_with_a_hot_leading_column(spark):
    """A third of the rows share the first sort column; the rest of the order splits them."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("zone"), "id"
    )
    keyed = dense_key(rows, "k", ["zone", "id"])
    wanted = rows.withColumn("w", F.row_number().over(Window.orderBy("zone", "id")))
    assert keyed.join(wanted.select("id", "w"), "id").where("k <> w").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = range_positions(rows, ["zone", "id"])
        sizes = ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in sizes) < 1000


def test_dense_key_of_no_rows(spark):
    empty = dense_key(spark.range(0), "k", ["id"])
    assert empty.columns == ["id", "k"] and empty.isEmpty()


def test_dense_key_plan_has_no_single_partition(spark):
    keyed = dense_key(spark.range(1000), "k", ["id"])
    plan = keyed._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_dense_key_writes_only_what_goes_on(spark, monkeypatch):
    from fogon.operators import dense_key as module

    staged, write = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: staged.append(df.columns) or write(df, label))
    rows = spark.range(0, 500, 1, 7).select(F.struct((499 - F.col("id")).alias("a"), F.lit("w" * 50).alias("b")).alias("wide"), "id")
    got = module.dense_key(rows, "k", ["wide"], keep=["id"])
    assert got.columns == ["id", "k"] and staged == [["id", "_pos"]]
    assert {r.id: r.k for r in got.collect()} == {i: 500 - i for i in range(500)}


def test_lines_meet_users_and_places_through_their_order(spark, monkeypatch):
    """Only what a line's row needs is sorted by its key; repeated and unknown keys as in plain joins."""
    frames, keyed = [], facts.dense_key
    monkeypatch.setattr(facts, "dense_key", lambda df, *a, **k: frames.append(df.columns) or keyed(df, *a, **k))
    make = spark.createDataFrame
    items = make(
        [("a", 1, 7, 1, 1.0, 1.0), ("b", 1, 8, 2, 1.0, 2.0), ("c", 2, None, 3, 1.0, 3.0), ("d", 3, 7, 4, 1.0, 4.0), ("e", None, 7, 5, 1.0, 5.0), ("f", 9, 7, 6, 1.0, 6.0)],
        "order_item_id string, order_id long, product_id long, quantity int, unit_price double, line_amount double",
    )
    orders = make(
        [(1, 10, 5, "2024-01-02 03:00:00", "completed"), (2, None, 5, None, "odd"), (3, 11, 6, "2024-02-02 04:00:00", "cancelled"), (3, 10, None, "2024-02-02 04:00:00", "pending")],
        "order_id long, user_id long, location_id long, created_at string, status string",
    )
    user = make([(10, 100), (10, 101), (None, 1)], "user_id long, user_key int")
    product = make([(7, 70), (None, 2)], "product_id long, product_key int")
    place = make([(5, 50)], "location_id long, location_key int")
    rows = facts.fact_order_items(items, orders, user, product, place).collect()
    got = sorted(((r.quantity, r.order_id, r.user_key, r.product_key, r.location_key, r.status_key) for r in rows), key=str)
    assert got == sorted([
        (1, 1, 100, 70, 50, 4), (1, 1, 101, 70, 50, 4), (2, 1, 100, None, 50, 4), (2, 1, 101, None, 50, 4),
        (3, 2, None, None, 50, None), (4, 3, None, 70, None, 5), (4, 3, 100, 70, None, 1), (4, 3, 101, 70, None, 1),
    ], key=str)
    assert sorted(r.order_item_key for r in rows) == list(range(1, 9))
    assert [r.quantity for r in sorted(rows, key=lambda r: r.order_item_key)] == [1, 1, 2, 2, 3, 4, 4, 4]
    assert not {"user_id", "product_id", "location_id", "is_cancelled"} & set(frames[0])


def test_shuffles_start_wide_whatever_the_session_has(spark):
    """Partitions follow the size of a shuffle, not the session's number of them."""
    from fogon.session import tune

    rows = tune(spark).range(0, 1_200_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    assert rows.repartition("id").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_revenue_state_alone_leaves_products_out(spark, monkeypatch):
    from fogon.plans import cubes

    items = spark.createDataFrame(
        [(1, 20240102, 1, 10, 1, 2, 3.5), (1, 20240102, 2, 10, 1, 1, 1.0), (1, 20240102, 3, 10, 1, 1, 2.0), (2, 20240203, 1, None, 1, 4, 8.0), (3, 20240203, 2, 11, 5, 4, 8.0)],
        "order_id long, date_key int, product_key int, user_key int, status_key smallint, quantity int, line_amount double",
    ).withColumn("line_amount", F.col("line_amount").cast("decimal(14,2)"))
    products = spark.createDataFrame([(1, "n", "x"), (2, "m", "x"), (3, "n", None)], "product_key int, product_name string, category string")
    want = cubes.states(None, items, None, products, names=("state_revenue", "state_products"))["state_revenue"].collect()
    monkeypatch.setattr(cubes, "_product_lines", None)
    got = cubes.states(None, items, None, products, names=("state_revenue",))["state_revenue"].collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3


def _lines(spark, sources, orders, lines, products, monkeypatch):
    """Lines of the given rows, and whether their key came before the look-ups."""
    seen = []
    monkeypatch.setattr(facts, "dense_key", lambda df, *a, **k: seen.append("user_key" not in df.columns) or dense_key(df, *a, **k))
    location, user, product = star(sources)
    made = facts.fact_order_items(lines, orders, user, product.where(F.col("product_id").isin(products)).unionByName(product.limit(0)), location)
    return sorted(map(tuple, made.collect())), seen == [True]


def test_lines_get_their_key_before_the_look_ups_where_those_keep_every_line(spark, sources, monkeypatch):
    orders, lines = sources["orders"], sources["order_items"]
    whole, early = _lines(spark, sources, orders, lines, ["p1", "p2"], monkeypatch)
    assert early
    # An order that no line refers to comes twice: it changes no line.
    twice = orders.unionByName(orders.limit(1).withColumn("order_id", F.lit("o9"))).unionByName(orders.limit(1).withColumn("order_id", F.lit("o9")))
    assert _lines(spark, sources, twice, lines, ["p1", "p2"], monkeypatch) == (whole, True)
    monkeypatch.setattr(facts, "_each_line_once", lambda *a: False)
    assert _lines(spark, sources, orders, lines, ["p1", "p2"], monkeypatch) == (whole, False)


def test_lines_are_numbered_after_look_ups_that_drop_or_repeat_them(spark, sources, monkeypatch):
    orders, lines = sources["orders"], sources["order_items"]
    some, early = _lines(spark, sources, orders.where("order_id = 'o2'"), lines, ["p1", "p2"], monkeypatch)
    assert not early and [(r[0], r[1]) for r in some] == [(1, "o2")]
    both, early = _lines(spark, sources, orders.unionByName(orders), lines, ["p1", "p2"], monkeypatch)
    assert not early and [r[0] for r in both] == [1, 2, 3, 4, 5, 6]
    bare = lines.withColumn("order_id", F.when(F.col("order_item_id") != "i2", F.col("order_id")))
    some, early = _lines(spark, sources, orders, bare, ["p1", "p2"], monkeypatch)
    assert not early and [(r[0], r[1]) for r in some] == [(1, "o1"), (2, "o2")]
    location, user, product = star(sources)
    again = product.unionByName(product.where("product_id = 'p1'").withColumn("product_key", F.lit(99)))
    made = facts.fact_order_items(lines, orders, user, again, location).collect()
    assert sorted(r.order_item_key for r in made) == [1, 2, 3, 4, 5]
