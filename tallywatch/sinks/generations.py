"""Reporting tables in generations: readers see one load whole, never a mix.

A load writes all its tables below a new number, reads them back and checks
them there. Only then one row with the number is appended to the list of
published generations, and that is the switch: readers take the greatest number
in the list. A load that fails leaves files nobody reads, and the tables before
it stay as they are. Generations that are no longer wanted expire by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallywatch.report.tables import table_schema
from tallywatch.sinks.writers import write_table

Check = Callable[[dict[str, DataFrame]], None]


class Generations:
    """Loads of reporting tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/generation={number:08d}"

    def _files(self):
        """The folder's file system and path, as any store that Spark writes to."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def written(self) -> list[int]:
        """Numbers of all loads, also of those that failed."""
        files, path = self._files()
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("generation="))

    def published(self) -> int | None:
        """The number that readers follow."""
        try:
            return self.spark.read.schema("number bigint").parquet(f"{self.folder}/published").selectExpr("MAX(number)").first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def tables(self, names: list[str], number: int | None = None) -> dict[str, DataFrame]:
        """The tables of the published generation, or of another one."""
        number = self.published() if number is None else number
        if number is None:
            raise LookupError(f"no generation is published in {self.folder}")
        return {n: self.spark.read.schema(table_schema(n)).parquet(f"{self._path(number)}/{n}") for n in names}

    def load(self, frames: dict[str, DataFrame], check: Check | None = None, keep: int = 2) -> dict[str, DataFrame]:
        """Write, check and publish one generation; ``keep`` published ones stay, this one included.

        Whatever fails before the last step is raised and changes nothing for readers.
        """
        number = max(self.written(), default=0) + 1
        for name, df in frames.items():
            write_table(df, name, f"{self._path(number)}/{name}")
        tables = self.tables(list(frames), number)
        if check:
            check(tables)
        self.spark.createDataFrame([(number,)], "number bigint").coalesce(1).write.mode("append").parquet(f"{self.folder}/published")
        self.expire(keep)
        return tables

    def expire(self, keep: int) -> list[int]:
        """Remove all but the last ``keep`` generations up to the published one; failed later loads stay for a look."""
        latest = self.published()
        old = [n for n in self.written() if latest is not None and n <= latest][: -max(1, keep)]
        files, _ = self._files()
        for n in old:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(n)), True)
        return old
