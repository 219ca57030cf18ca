"""Class weights and standardisation, fitted on training rows only."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from tallywatch.functions.exprs import double


def class_weights(train: DataFrame, label: str = "isFraud") -> DataFrame:
    """(label, rows, weight): all rows over twice the rows of the class."""
    counts = train.where(f"{label} IS NOT NULL").groupBy(label).count()
    return counts.selectExpr(
        label,
        "count AS row_count",
        f"{double('SUM(count) OVER ()')} / (2D * {double('count')}) AS weight",
    )


def with_class_weight(train: DataFrame, label: str = "isFraud", name: str = "weight") -> tuple[DataFrame, int]:
    """Add the balanced weight of each row's class; also returns the row count.

    The two weights are read once and put in as literals, so training rows are
    neither joined nor shuffled. They sum to the row count. A label with more
    than two values raises.
    """
    classes = class_weights(train, label).take(3)
    if len(classes) > 2:
        raise ValueError(f"{label} has more than two values")
    arms = " ".join(f"WHEN {r[label]} THEN {r['weight']!r}D" for r in classes)
    return train.selectExpr("*", f"CASE {label} {arms} END AS {name}"), sum(r["row_count"] for r in classes)


def scaling_moments(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, from one pass."""
    row = train.selectExpr(
        *[f"AVG({double(c)}) AS {c}_mean" for c in columns],
        *[f"stddev_pop({double(c)}) AS {c}_std" for c in columns],
    ).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"] or 1.0) for c in columns}


def scale_columns(moments: dict[str, tuple[float, float]]) -> list[str]:
    """Standardised expressions; a constant column is only centred."""
    return [f"({double(c)} - {mean!r}D) / {std!r}D AS {c}_z" for c, (mean, std) in moments.items()]


def scaler(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """A pipeline stage that adds the standardised columns.

    The library's own scaler divides by the sample deviation; this one uses the
    population deviation, and can be saved inside a pipeline.
    """
    scaled = ", ".join(scale_columns(scaling_moments(train, columns)))
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
