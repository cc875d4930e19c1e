"""Every query on data where one key of each kind holds about a third of the rows.

One order holds a third of the lines (more than the wide-basket limit), one part is in
a third of the lines, one customer places a third of the orders, one nation (so one
zone) holds a third of the customers and one user a third of the events.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

BASE = "/root/testdata/sf0.001"
SKEWED = {
    "lineitem": f"""
SELECT * REPLACE (CASE WHEN r % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
                  CASE WHEN r % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey,
                  CAST(r AS INTEGER) AS l_linenumber)
FROM (SELECT *, row_number() OVER () AS r FROM '{BASE}/lineitem.parquet') """,
    "orders": f"""
SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey)
FROM '{BASE}/orders.parquet'""",
    "customer": f"""
SELECT * REPLACE (CAST(CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_nationkey END AS INTEGER) AS c_nationkey)
FROM '{BASE}/customer.parquet'""",
    "events": f"""
SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 11 ELSE user_id END AS user_id) FROM '{BASE}/events.parquet'""",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split():
        source = SKEWED.get(name, f"SELECT * FROM '{BASE}/{name}.parquet'")
        rows = source.replace("SELECT * REPLACE", "SELECT * EXCLUDE (r) REPLACE") if name == "lineitem" else source
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


NAMES = [n for n in entry.oracle_sql() if not n.startswith(("ds_", "dim_", "src_", "op"))]


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_data(spark, skewed, name):
    equal, message = compare(
        spark, duck(skewed), skewed, name, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert equal, message
