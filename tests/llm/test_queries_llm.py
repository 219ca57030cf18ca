"""The text queries that have SQL, against DuckDB; the others run whole."""

import duckdb
import pytest
from conftest import comparable

from tallywatch.llm.queries import QUERIES, SQL

TABLES = ["documents", "embeddings", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data):
    frame = QUERIES[name](spark, data)
    rows = frame.collect()
    assert rows
    if name in SQL:
        connection = duckdb.connect()
        for t in TABLES:
            connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        expected = connection.sql(SQL[name])
        assert sorted(frame.columns) == sorted(expected.columns)
        assert comparable(rows, frame.columns) == comparable(expected.fetchall(), expected.columns)


def test_names():
    for n in range(1, 14):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
