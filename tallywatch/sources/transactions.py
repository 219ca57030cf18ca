"""Scans: CSV and Parquet transactions, row counts and file-order ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tallywatch import schema as S
from tallywatch.functions.exprs import nan_to_null
from tallywatch.session import materialise

# Where a CSV row stands: its file, the block that a task reads at one go, and
# the order in which that task met it.
_PLACE = ["__file", "__block", "__met"]


CORRUPT = "__corrupt"


class BadRows(ValueError):
    """Lines of a CSV that do not fit the schema."""


def read_csv(spark: SparkSession, path: str, money: T.DataType | None = None) -> DataFrame:
    """Full CSV scan with the declared schema; NaN becomes NULL.

    Rows that do not parse count too, with NULL for what could not be read; see
    ``split_rows`` to tell them apart.
    """
    return nan_to_null(_scan(spark, path, S.transactions_schema(money)))


def _scan(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def read_csv_placed(spark: SparkSession, path: str, money: T.DataType | None = None) -> DataFrame:
    """The CSV with the columns that put its rows in order, by file name, then as they stand in the file, and
    ``CORRUPT``: the line, where it does not fit the schema (too few or many fields, text in a number).

    Tasks read files in order of size, so without these the order over several
    files is not defined.
    """
    frame = _scan(spark, path, S.transactions_schema(money).add(CORRUPT, T.StringType()))
    placed = frame.selectExpr(
        "*",
        "_metadata.file_path AS __file",
        "_metadata.file_block_start AS __block",
        "monotonically_increasing_id() AS __met",
    )
    return nan_to_null(placed)


def split_rows(spark: SparkSession, path: str, money: T.DataType | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and the others as (file, block, line)."""
    placed = read_csv_placed(spark, path, money)
    # written once with all columns: a scan cannot tell bad lines when only their text is asked for
    bad = materialise(placed.where(f"{CORRUPT} IS NOT NULL")).selectExpr("__file AS file", "__block AS block", f"{CORRUPT} AS line")
    return placed.where(f"{CORRUPT} IS NULL").drop(CORRUPT, *_PLACE), bad


def read_csv_sample(
    spark: SparkSession, path: str, rows: int = 100_000, money: T.DataType | None = None
) -> DataFrame:
    """The first ``rows`` rows by file name and place, for a quick look.

    Files are opened in order of name until there are enough rows, each from its
    start, so a look at a large folder touches one file. The sample itself, of
    the size asked for, comes to the driver.
    """
    schema = S.transactions_schema(money)
    files = sorted(spark.read.schema(schema).csv(path).inputFiles())
    parts, left = [], int(rows)
    for file in files:
        if left <= 0:
            break
        parts.append(_scan(spark, file, schema).limit(left).toArrow())  # reads split after split, up to the limit
        left -= parts[-1].num_rows
    if not parts:
        return spark.createDataFrame([], schema)
    return nan_to_null(spark.createDataFrame(pa.concat_tables(parts), schema))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """Data lines of a CSV file or folder: text lines minus one header per file that has lines."""
    lines = spark.read.text(path).selectExpr("_metadata.file_path AS file")
    per_file = lines.groupBy("file").agg(F.expr("COUNT(*) - 1 AS n"))
    return per_file.selectExpr("COALESCE(SUM(n), 0) AS total_rows")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Projected Parquet scan; only the named columns are read."""
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def parquet_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Row count of a Parquet table; a scan of no columns, served by footers."""
    return spark.read.parquet(path).selectExpr("COUNT(*) AS row_count")


def land_csv(spark: SparkSession, csv_path: str, parquet_path: str, rejected_path: str | None = None) -> DataFrame:
    """Convert the CSV once to Parquet, in file order.

    Later scans prune columns, and every row has a stable position: the parts
    are written in order of the sort, so (part name, row index) is file order.

    Lines that do not fit the schema are counted on the way. They raise
    ``BadRows`` with the first of them, or, with ``rejected_path``, are written
    there with file and block while the others land.
    """
    seen = Observation()
    placed = read_csv_placed(spark, csv_path).observe(seen, F.expr(f"COUNT({CORRUPT}) AS bad"), F.expr(f"MIN({CORRUPT}) AS line"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.where(f"{CORRUPT} IS NULL").repartitionByRange(parts, *_PLACE).sortWithinPartitions(*_PLACE)
    ordered.drop(CORRUPT, *_PLACE).write.mode("overwrite").parquet(parquet_path)
    if rejected_path:
        split_rows(spark, csv_path)[1].write.mode("overwrite").parquet(rejected_path)
    elif seen.get["bad"]:
        raise BadRows(f"{seen.get['bad']} lines that do not fit the schema, such as {seen.get['line']!r}")
    return spark.read.parquet(parquet_path)


def with_transaction_id(frame: DataFrame, name: str = "transaction_id") -> DataFrame:
    """1-based ids in file order for a frame read straight from Parquet.

    The id is the number of rows in all files before this one plus the row's
    index in its own file. Both come from Parquet metadata, so ids do not depend
    on how the scan is split. The offsets are one small row per file; whether
    they are sent to all tasks is decided by their true size.
    """
    columns = [c for c in frame.columns if c != "_metadata"]
    placed = frame.selectExpr(
        *columns, "_metadata.file_path AS __file", "_metadata.row_index AS __row"
    )
    offsets = placed.groupBy("__file").count().selectExpr(
        "__file",
        "COALESCE(SUM(count) OVER (ORDER BY __file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before",
    )
    return placed.join(offsets, "__file").selectExpr(f"__before + __row + 1 AS {name}", *columns)


def head_rows(master: DataFrame, rows: int = 5) -> DataFrame:
    """The first processed rows, in id order, for a visual check."""
    shown = [
        "transaction_id", "step", "transaction_day", "hour_of_day", "type", "amount",
        "log_amount", "zero_amount_flag", "high_value_200k_flag",
        "destination_is_merchant", "isFraud",
    ]
    return master.orderBy("transaction_id").select(*shown).limit(rows)
