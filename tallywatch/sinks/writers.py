"""Sinks: Parquet stages, small CSV summaries, catalog and database tables.

Every write replaces its target as a whole, so a failed run leaves no half-new
stage behind and a repeated run gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallywatch.report.tables import LAYOUTS, column_names, table_schema


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write snappy Parquet and return the written table."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header. Only for summaries of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts written in parallel, a header in each; null as an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_observed(df: DataFrame, path: str, measures: dict[str, str]) -> tuple[DataFrame, dict]:
    """Write Parquet and count while the rows pass: the written table, and the measures of what was processed."""
    seen = Observation()
    write_parquet(df.observe(seen, *[F.expr(e).alias(n) for n, e in measures.items()]), path)
    return df.sparkSession.read.parquet(path), seen.get


def write_table(df: DataFrame, table: str, path: str, days_only: bool = False) -> DataFrame:
    """Write a reporting table in its layout (see ``tables.LAYOUTS``).

    Large tables are dealt by range over their order, so files and row groups
    hold neighbouring keys, and filters on them skip the rest; Bloom filters serve
    look-ups of single ids. With ``days_only`` only the partitions that the frame
    holds are replaced; all others stay.
    """
    layout, spark = LAYOUTS.get(table), df.sparkSession
    rows = df.select(*column_names(table))
    if layout is None:
        rows.coalesce(1).write.mode("overwrite").parquet(path)  # a summary of a few rows
        return spark.read.schema(table_schema(table)).parquet(path)
    order = [*layout.partition_by, *layout.order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite")
    for column in layout.lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer = writer.option("partitionOverwriteMode", "dynamic" if days_only else "static")
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    writer.parquet(path)
    return spark.read.schema(table_schema(table)).parquet(path)


def save_table(df: DataFrame, database: str, table: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a catalog table by a conformed frame in one distributed write."""
    writer = df.select(*column_names(table)).write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(f"{database}.{table}")
    return df.sparkSession.table(f"{database}.{table}")


def reload_tables(frames: dict[str, DataFrame], database: str) -> dict[str, DataFrame]:
    """Replace every given reporting table."""
    return {table: save_table(df, database, table) for table, df in frames.items()}


def write_stages(frames: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Replace every given stage below a folder and read it back."""
    return {name: write_parquet(df, f"{folder}/{name}") for name, df in frames.items()}


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def copy_to_database(df: DataFrame, url: str, table: str, options: dict[str, str] | None = None,
                     batch_rows: int = 100_000, truncate: bool = True) -> None:
    """Load a frame into a relational table over JDBC.

    ``truncate`` keeps the table's definition, keys and indexes; each partition
    writes its own batches.
    """
    (
        df.write.mode("overwrite" if truncate else "append")
        .format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_rows), truncate=str(truncate).lower())
        .options(**(options or {}))
        .save()
    )
