"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows, types_differ

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).collect()[0].column_name == "o_orderpriority"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert types_differ(df, con, SQL[name]) == []
    assert spark_rows(df) == sql_rows(con, SQL[name])
