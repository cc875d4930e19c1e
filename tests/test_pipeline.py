"""The whole load on hand-made rows, and what the checks say about broken tables."""

import pytest
from pyspark.sql import functions as F

from fogon.plans import cubes, pipeline, quality, serving
from fogon.schemas import ANALYSES, CUBES, DIMENSIONS, FACTS, SERVING_SCHEMAS, struct_of
from fogon.sources.catalog import register_tables
from fogon.sources.lake import Lake


@pytest.fixture(scope="module")
def lake(spark, sources, tmp_path_factory):
    made = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    pipeline.run(sources.__getitem__, made)
    return made


def gold(lake, name):
    return lake.read("gold", name)


def test_counts_of_the_load(lake):
    tables = {t: gold(lake, t) for t in (*FACTS, *cubes.CUBE_KEYS)}
    counts = {r["table_name"]: r["n_rows"] for r in pipeline.counts(tables).collect()}
    assert counts["fact_orders"] == 2 and counts["fact_order_items"] == 3
    assert counts["fact_reservations"] == 2
    assert all(counts[c] > 0 for c in cubes.CUBE_KEYS)


def test_bronze_mirrors_the_sources(lake, sources):
    for name, df in sources.items():
        back = lake.read("bronze", name)
        assert back.columns == df.columns and back.count() == df.count()


def test_cube_levels_and_grand_total(lake):
    cube = gold(lake, "cube_revenue_time_category")
    rows = {(r["grp_flag"], r["category"]): r for r in cube.collect()}
    assert {f for f, _ in rows} == {0, 1, 3, 7, 14, 15}
    # the cancelled order is left out: one order, two categories
    assert rows[(15, None)]["revenue"] == 3700 and rows[(15, None)]["orders"] == 1
    assert rows[(15, None)]["avg_ticket"] == 3700
    assert rows[(14, "Soup")]["orders"] == 1 and rows[(14, "Tea")]["orders"] == 1
    assert rows[(0, "Tea")]["revenue"] == 700


def test_location_cube_has_zone_level_and_no_grand_total(lake):
    rows = gold(lake, "cube_sales_by_location").collect()
    assert {r["grp_flag"] for r in rows} == {0, 1, 3, 7}
    assert all(r["zone"] is not None for r in rows)


def test_status_cube_counts_every_order(lake):
    top = gold(lake, "cube_orders_status").where("grp_flag = 3").first()
    assert (top["total_orders"], top["completed"], top["cancelled"]) == (2, 1, 1)
    assert float(top["cancel_rate_pct"]) == 50.0
    assert (top["realised_revenue"], top["lost_revenue"]) == (3500, 1500)


def test_peak_cube_level_three_is_dayparts_and_total(lake):
    rows = gold(lake, "cube_peak_hours").where("grp_flag = 3").collect()
    assert {r["daypart"] for r in rows} == {"tarde", None}


def test_activity_cube_ratio(lake):
    row = gold(lake, "cube_customer_activity").where("grp_flag = 7").first()
    assert (row["active_customers"], row["orders"]) == (1, 1)
    assert float(row["orders_per_customer"]) == 1.0 and row["revenue_per_customer"] == 3500


def test_product_cube_counts_buyers(lake):
    row = gold(lake, "cube_product_frequency").where("grp_flag = 7").first()
    assert (row["units_sold"], row["times_ordered"], row["distinct_buyers"]) == (3, 1, 1)


def test_gold_facts_and_frames_give_the_same_cubes(lake, sources):
    from fogon.plans import facts

    frames = cubes.all_cubes(
        facts.orders_frame(sources["orders"]),
        facts.order_items_frame(sources["order_items"], sources["orders"]),
        sources["locations"],
        sources["products"],
    )
    for name, df in frames.items():
        stored = gold(lake, name).select(*df.columns)
        assert df.exceptAll(stored).isEmpty() and stored.exceptAll(df).isEmpty(), name


def test_analyses(lake):
    trends = gold(lake, "analysis_consumption_trends").collect()
    assert sum(r["revenue"] for r in trends) == 5200  # cancelled lines included
    growth = gold(lake, "analysis_monthly_growth").collect()
    assert len(growth) == 1 and growth[0]["prev_revenue"] is None
    assert growth[0]["revenue_growth_pct"] is None
    peaks = gold(lake, "analysis_peak_hours").collect()
    assert [(r["day_of_week"], r["hour"], r["orders"]) for r in peaks] == [(5, 13, 1)]


def test_checks_pass_on_a_sound_load(lake, capsys):
    rows = quality.enforce(pipeline.check(lake))
    assert all(ok for _, _, ok in rows)
    assert "primary key fact_orders" in {name for name, _, _ in rows}
    assert "-> OK" in capsys.readouterr().out


def test_checks_find_what_is_broken(lake):
    orders, items = gold(lake, "fact_orders"), gold(lake, "fact_order_items")
    product = lake.read("silver", "dim_product")
    broken = items.withColumn("product_key", F.when(F.col("quantity") > 0, F.lit(None).cast("int")))
    assert quality.orphans(broken, product, "product_key", "x").first()["value"] == 3
    gone = product.where("product_key > 1")
    assert quality.orphans(items, gone, "product_key", "x").first()["value"] == 2
    negative = orders.withColumn("net_amount", -F.col("net_amount"))
    assert quality.no_negative_amounts(negative).first()["value"] == 2
    twice = orders.unionByName(orders)
    assert quality.duplicate_keys(twice, ["order_key"], "x").first()["ok"] is False
    nulls = {r["check_name"]: r["ok"] for r in quality.null_counts(
        orders.withColumn("user_key", F.lit(None).cast("int")), "fact_orders").collect()}
    assert nulls["not null fact_orders.user_key"] is False
    assert nulls["not null fact_orders.order_id"] is True
    assert quality.not_empty(orders.limit(0), "x").first()["ok"] is False
    cube = gold(lake, "cube_revenue_time_category")
    off = cube.withColumn("revenue", F.when(F.col("grp_flag") == 15, 1).otherwise(F.col("revenue")))
    assert quality.grand_total_matches_leaves(off).first()["ok"] is False
    with pytest.raises(ValueError, match="no negative"):
        quality.enforce(quality.no_negative_amounts(negative))


def test_serving_order_and_contract(lake):
    seen = {}
    names = pipeline.load_serving(lake, lambda df, table: seen.__setitem__(table, df.schema))
    assert names == [*DIMENSIONS, *FACTS, *ANALYSES, *CUBES]
    for name, schema in seen.items():
        want = struct_of(SERVING_SCHEMAS[name])
        assert [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in want]


def test_registered_tables_answer_sql(spark, lake):
    names = register_tables(spark, lake, "test_lake")
    assert len(names) == 18
    register_tables(spark, lake, "test_lake")  # again: drop and create
    n = spark.sql(
        "SELECT count(*) FROM test_lake.fact_orders f JOIN test_lake.dim_user u USING (user_key)"
    ).first()[0]
    assert n == 2


def test_datasets(lake):
    status = gold(lake, "cube_orders_status")
    assert float(serving.overall_cancel_rate(status).first()["cancel_rate_pct"]) == 50.0
    top = serving.top_peak_hours(gold(lake, "cube_peak_hours")).collect()
    assert [tuple(r) for r in top] == [("viernes", 13, 1)]
    heat = serving.peak_hours_heatmap(gold(lake, "analysis_peak_hours"))
    assert heat.columns[:2] == ["day_of_week", "day_name"]


def test_frames_of_the_version_before_a_refresh_still_read(lake):
    before = gold(lake, "cube_product_frequency")
    rows = sorted(map(str, before.collect()))
    pipeline.refresh_cubes(lake, ("cube_product_frequency",))
    assert sorted(map(str, before.collect())) == rows == sorted(map(str, gold(lake, "cube_product_frequency").collect()))


def test_a_load_leaves_nothing_staged(spark, sources, tmp_path):
    from fogon.operators.staging import staging_root
    from fogon.sources.files import folders

    before = set(folders(staging_root(spark)))
    pipeline.run(sources.__getitem__, Lake(spark, str(tmp_path)))
    assert set(folders(staging_root(spark))) == before


def test_unknown_buyers_are_not_counted(spark):
    lines = spark.createDataFrame(
        [("o1", 20230801, 1, "soup", "a", 2, 5.0), ("o2", 20230802, None, "soup", "a", 1, 5.0), ("o3", 20230802, 1, "tea", "b", 1, 2.0)],
        "order_id string, date_key int, user_key int, product_name string, category string, quantity bigint, line_amount double",
    )
    rows = {r["grp_flag"]: r for r in cubes.cube_product_frequency(lines).where("category = 'a' OR grp_flag = 7").collect()}
    assert (rows[7]["distinct_buyers"], rows[7]["times_ordered"]) == (1, 3)
    assert (rows[3]["distinct_buyers"], rows[3]["times_ordered"]) == (1, 2)


def test_product_cube_joins_nothing_and_orders_no_rows(spark):
    lines = spark.createDataFrame(
        [("o1", 20230801, 1, "soup", "a", 2, 5.0)],
        "order_id string, date_key int, user_key int, product_name string, category string, quantity bigint, line_amount double",
    )
    plan = cubes.cube_product_frequency(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
