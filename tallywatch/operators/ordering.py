"""Global order without one giant partition: ranks and running totals.

A window with no PARTITION BY pulls every row into one task. Here the rows are
range-partitioned on the sort key instead, numbered or summed inside their own
partition, and shifted by the totals of the partitions before them. Those
totals are one row per partition, so their window and broadcast are bounded by
the partition count, not by the data.

The range-partitioned rows are written once (``materialise``): range bounds
come from a sample, so a second evaluation could cut the rows elsewhere and the
offsets would no longer fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.session import materialise

_BEFORE = "OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sort_keys(order: Sequence[str]) -> list[Column]:
    """Sort columns from texts such as ``score DESC``."""
    return [F.desc(o.split()[0]) if o.upper().endswith(" DESC") else F.asc(o.split()[0]) for o in order]


def global_row_number(
    df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Add 1..n in the given order. The order must be total (end on a key).

    A value shared by a third of the rows is no hot spot: the key column at the
    end of the order lets the range partitioner cut inside equal values.
    """
    keys = sort_keys(order)
    placed = materialise(
        df.repartitionByRange(_partitions(df, partitions), *keys)
        .sortWithinPartitions(*keys)
        .selectExpr("*", "monotonically_increasing_id() AS place")
    ).selectExpr(
        "*", f"shiftright(place, {_ROW_BITS}) AS part", f"place & {(1 << _ROW_BITS) - 1}L AS row_index"
    )
    offsets = placed.groupBy("part").count().selectExpr(
        "part", f"COALESCE(SUM(count) {_BEFORE}, 0) AS rows_before"
    )
    return placed.join(F.broadcast(offsets), "part").selectExpr(
        *df.columns, f"row_index + rows_before + 1 AS {name}"
    )


def _cumulated(segments: Sequence[str], sums: dict[str, str]):
    """Running sums inside a sorted partition, beginning anew with each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros((len(sums), 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64) for source in sums.values()])
            starts = np.zeros(batch.num_rows, bool)
            first = tuple(batch.column(c)[0].as_py() for c in segments)
            starts[0] = first != last
            for c in segments:
                column = batch.column(c)
                starts[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            totals = np.cumsum(values, axis=1)
            before = np.concatenate([-carried, totals[:, :-1]], axis=1)  # what a segment that begins here takes off
            at = np.maximum.accumulate(np.where(starts, np.arange(batch.num_rows), -1))
            totals -= np.where(at < 0, -carried, before[:, at] + np.where(at == 0, carried, 0))
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in segments)
            carried = totals[:, -1:].copy()
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, totals)], names=[*batch.schema.names, *sums])

    return run


def running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], partitions: int | None = None, segments: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums of long columns in the given order, per segment if segments are named.

    ``sums`` maps an output name to the column it accumulates; ``order`` holds
    names or ``name DESC``, and must be unique per row and segment, as after a
    ``groupBy`` on the ordered columns. Segments have no nulls and are few, such
    as models and splits; one may hold most of the rows.

    There is one exchange, by range over segments and order. Each partition is
    summed as it is sorted, and the totals of the partitions before it, one row
    per partition and segment, are added.
    """
    keys = sort_keys([*segments, *order])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` bigint" for out in sums])
    placed = materialise(
        df.repartitionByRange(_partitions(df, partitions), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_cumulated(list(segments), dict(sums)), fields)
        .selectExpr("*", "spark_partition_id() AS part")
    )
    by = ["part", *segments]
    inside = f"PARTITION BY {', '.join(segments)} " if segments else ""
    before = _BEFORE.replace("(", "(" + inside, 1)
    totals = placed.groupBy(*by).agg(*[F.expr(f"SUM({s}) AS {out}") for out, s in sums.items()])
    offsets = totals.selectExpr(*by, *[f"COALESCE(SUM({out}) {before}, 0) AS {out}_before" for out in sums])
    return placed.join(F.broadcast(offsets), by).selectExpr(*df.columns, *[f"{out} + {out}_before AS {out}" for out in sums])


def bounded_rank(df: DataFrame, order: Sequence[str], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows with ranks 1..limit.

    Each task keeps its own best ``limit`` rows (TakeOrderedAndProject), so the
    single-task window that numbers them sees at most ``limit`` rows.
    """
    keys = sort_keys(order)
    best = df.orderBy(*keys).limit(limit)
    return best.selectExpr("*", f"ROW_NUMBER() OVER (ORDER BY {', '.join(order)}) AS {name}")
