import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallywatch.session import configure  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["orders", "customer"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        configure(SparkSession.builder)
        .master("local[8]")
        .appName("tallywatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.fixture(scope="session")
def data():
    return DATA


def comparable(rows, columns):
    """Rows as sorted tuples in column-name order, NaN made equal to itself."""
    order = sorted(columns)
    position = [columns.index(c) for c in order]
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else (v + 0 if isinstance(v, float) else v)
    return sorted([tuple(clean(row[i]) for i in position) for row in rows], key=repr)
