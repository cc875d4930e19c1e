"""The command-line steps over CSV files, and the session helper."""

import pytest

from fogon.operators.staging import drop_staged, stage, staging_root
from fogon.plans import jobs
from fogon.session import RUNTIME_CONF, get_spark, tune
from fogon.sources.lake import Lake


def test_all_steps_from_csv(spark, sources, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SOURCE_PATH", str(tmp_path / "source"))
    for name, df in sources.items():
        df.write.option("header", True).csv(f"{tmp_path}/source/{name}.csv")
    lake = Lake(spark, f"{tmp_path}/lake")
    jobs.run_steps(spark, lake, list(jobs.DEFAULT_STEPS))
    out = capsys.readouterr().out
    assert "[facts] fact_order_items: 3 rows" in out
    assert "[graph] graph_edge_recommended: 1 rows" in out
    assert "FAIL" not in out
    assert lake.read("gold", "route_stops").count() == 0  # nothing waits for delivery


def test_unknown_step_is_refused():
    with pytest.raises(SystemExit):
        jobs.main(["dance"])


def test_load_step_writes_every_table(spark, sources, tmp_path, monkeypatch):
    lake = Lake(spark, f"{tmp_path}/lake")
    from fogon.plans import pipeline

    pipeline.run(sources.__getitem__, lake, enforce=False)
    seen = []
    monkeypatch.setattr(jobs, "write_warehouse", lambda df, table: seen.append(table))
    jobs.run_steps(spark, lake, ["load"])
    assert seen[0] == "dim_date" and seen[-1] == "cube_customer_activity" and len(seen) == 18


def test_session_helper_sets_runtime_options(spark):
    assert tune(spark) is spark
    assert get_spark("again").conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())


def test_staging_uses_the_session_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert staging_root(spark) == named.rstrip("/")
    df = stage(spark.range(5), "t")
    assert df.count() == 5 and staging_root(spark) in df.inputFiles()[0]
    file = df.inputFiles()[0]
    drop_staged(df)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        spark.read.parquet(file).count()


def test_only_staged_tables_can_be_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mine")
    with pytest.raises(ValueError, match="not a staged table"):
        drop_staged(spark.read.parquet(f"{tmp_path}/mine"))
