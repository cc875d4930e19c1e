"""Every registered query against its DuckDB statement on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
# The training-data queries have tests of their own, beside their subpackage.
QUERIES = {name: query for name, query in entry.queries().items() if name in entry.PLANS}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in entry.PLANS}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    equal, message = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert equal, message


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "revenue" in df.columns and df.count() > 0
