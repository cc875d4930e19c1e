"""Run a registered query on Spark and its statement on DuckDB and compare the rows.

``python -m tests.compare [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(
        (tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr
    )


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(
        (tuple(normal(r[i]) for i in order) for r in cur.fetchall()), key=repr
    )


def compare(spark, con, sf_dir, name, query, sql):
    """(equal, message)"""
    t0 = time.time()
    s_cols, s_rows = spark_rows(query(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return True, f"rows {len(s_rows)}, no oracle, spark {t1 - t0:.2f}s"
    d_cols, d_rows = duck_rows(con, sql)
    t2 = time.time()
    timing = f"spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s"
    if s_cols != d_cols:
        return False, f"columns {s_cols} != {d_cols}"
    if s_rows != d_rows:
        only_s = [r for r in s_rows if r not in set(d_rows)][:3]
        only_d = [r for r in d_rows if r not in set(s_rows)][:3]
        return False, f"rows {len(s_rows)} / {len(d_rows)} {s_cols}\n   spark {only_s}\n   duck  {only_d}"
    return True, f"rows {len(s_rows)} equal, {timing}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in argv[1:] or queries:
        try:
            ok, message = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as error:  # report and go on to the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("OK  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failures {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
