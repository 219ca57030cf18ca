"""Every named query that has SQL, against DuckDB on the same tables."""

import pytest
from conftest import comparable

import __spark_entry__ as entry_points
from tallywatch.plans import catalog, oracle

SQL = oracle.build()
QUERIES = catalog.QUERIES
KINDS = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint",
    "DOUBLE": "double", "VARCHAR": "string",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck, data):
    frame = QUERIES[name](spark, data)
    expected = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS.get(k) for c, k in kinds.items()} == dict(frame.dtypes)
    assert comparable(frame.collect(), frame.columns) == comparable(expected.fetchall(), expected.columns)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["Transaction_Type"] for r in rows} == {"CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"}
