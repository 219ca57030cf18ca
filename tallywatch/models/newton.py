"""Balanced logistic regressions by Newton steps, several feature sets in one pass.

A model has a dozen columns at most, so a step needs little more than their
weighted cross products: each pass reads the rows once and sums loss, gradient
and Hessian of every feature set that has not converged, per partition and then
by a group-by. What reaches the driver is one number per set and pair of
columns. A step that does not lower the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.exprs import double
from tallywatch.models.scaling import scale_columns

PROBABILITY = "fraud_probability__"
_TOLERANCE = 1e-10  # largest part of a step at which a set has converged
_HOLD = 1e-10  # penalty of the intercept: holds it finite when one class only is present

FeatureSets = dict[str, tuple[list[str], list[str]]]


class LogisticFit(NamedTuple):
    pipeline: PipelineModel
    features: list[str]
    coefficients: list[float]
    intercept: float
    passes: int


def filled(columns: dict[str, tuple[str, float]]) -> SQLTransformer:
    """A pipeline stage that adds ``<name>_known``: the column, or its stand-in where it is missing."""
    parts = [f"COALESCE(nanvl({double(c)}, NULL), {stand_in!r}D) AS {name}_known" for name, (c, stand_in) in columns.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def _unpacked(values: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian from their sums in a row."""
    upper = np.zeros((k, k))
    upper[np.triu_indices(k)] = values[1 + k :]
    return values[0], values[1 : 1 + k], upper + np.triu(upper, 1).T


def _sum_rows(places: dict[int, list[int]], betas: dict[int, np.ndarray], weights: dict[int, tuple[float, float]], width: int):
    """Per task and set: loss, gradient and upper Hessian at the set's coefficients, in long form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(1 + len(b) + len(b) * (len(b) + 1) // 2) for s, b in betas.items()}
        for batch in batches:
            columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width + 1)], axis=1)
            for s, b in betas.items():
                x = columns[:, places[s]]
                known = ~np.isnan(x).any(axis=1)
                x, y = np.hstack([x[known], np.ones((known.sum(), 1))]), columns[known, width]
                z = x @ b
                w = np.where(y == 1, weights[s][1], weights[s][0])
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                sums[s][0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                sums[s][1 : 1 + len(b)] += x.T @ (w * (p - y))
                sums[s][1 + len(b) :] += ((x * (w * p * (1 - p))[:, None]).T @ x)[np.triu_indices(len(b))]
        for s, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), s, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                names=["member", "k", "value"],
            )

    return run


def fit_sets(train: DataFrame, sets: FeatureSets, iterations: int = 500, label: str = "isFraud") -> dict[str, LogisticFit]:
    """One regression per feature set, (continuous, binary) columns each, on the same rows.

    Half the squared norm of the coefficients plus the log loss, with weights
    that give both classes half of the rows, on columns standardised over all
    training rows. Rows with a missing feature are left out of that set's fit;
    in scoring a missing value counts as the training mean, a missing flag as not
    set. Rows without a label are left out. A label other than 0 and 1, or no
    rows at all, raises ``ValueError``.
    """
    continuous = list(dict.fromkeys(c for part in sets.values() for c in part[0]))
    binary = list(dict.fromkeys(c for part in sets.values() for c in part[1]))
    columns = continuous + binary
    known = {n: " AND ".join(f"nanvl({double(c)}, NULL) IS NOT NULL" for c in a + b) or "TRUE" for n, (a, b) in sets.items()}
    row = train.selectExpr(
        f"COUNT_IF({label} NOT IN (0, 1)) AS odd",
        *[f"AVG({double(c)}) AS {c}_mean" for c in continuous],
        *[f"stddev_pop({double(c)}) AS {c}_std" for c in continuous],
        *[f"COUNT_IF({label} = {y} AND {test}) AS n{i}_{y}" for i, test in enumerate(known.values()) for y in (0, 1)],
    ).first()
    if row["odd"]:
        raise ValueError(f"{label} has other values than 0 and 1")
    moments = {c: (row[f"{c}_mean"], row[f"{c}_std"] or 1.0) for c in continuous}
    if any(row[f"n{i}_0"] + row[f"n{i}_1"] == 0 for i in range(len(sets))):
        raise ValueError("there are no rows to learn from")
    weights = {}
    for i in range(len(sets)):
        count = [row[f"n{i}_0"], row[f"n{i}_1"]]
        weights[i] = tuple(sum(count) / (2 * n) if n else 0.0 for n in count)
        if not all(count):  # as balanced weights do with one class
            weights[i] = (1.0, 1.0)
    rows = train.where(f"{label} IS NOT NULL").selectExpr(*scale_columns(moments), *[f"{double(c)} AS {c}" for c in binary], f"{double(label)} AS y")

    names = list(sets)
    places = {i: [columns.index(c) for c in sets[n][0] + sets[n][1]] for i, n in enumerate(names)}
    at = {i: np.zeros(len(places[i]) + 1) for i in places}  # the coefficients tried next
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, coefficients, step
    passes = dict.fromkeys(places, 0)
    open_ = set(places)
    for _ in range(iterations):
        if not open_:
            break
        tried = {i: at[i] for i in open_}
        summed = (
            rows.mapInArrow(_sum_rows({i: places[i] for i in open_}, tried, weights, len(columns)), "member int, k int, value double")
            .groupBy("member", "k").agg(F.sum("value").alias("value")).toArrow()
        )
        member, k, value = (summed.column(c).to_numpy() for c in ("member", "k", "value"))
        for i in sorted(open_):
            own = value[member == i][np.argsort(k[member == i])]
            loss, gradient, hessian = _unpacked(own, len(at[i]))
            penalty = np.append(np.ones(len(at[i]) - 1), _HOLD)
            loss += (penalty * at[i] ** 2).sum() / 2
            passes[i] += 1
            if i in best and loss > best[i][0] + 1e-12 * abs(best[i][0]):
                best[i] = (*best[i][:2], best[i][2] / 2)
            else:
                best[i] = (loss, at[i], np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * at[i]))
            at[i] = best[i][1] - best[i][2]
            if np.abs(best[i][2]).max() < _TOLERANCE:
                open_.discard(i)
    return {n: _fitted(moments, *sets[n], at[i].tolist(), passes[i]) for i, n in enumerate(names)}


def _fitted(moments: dict[str, tuple[float, float]], continuous: list[str], binary: list[str], beta: list[float], passes: int) -> LogisticFit:
    """The coefficients as a pipeline of SQL expressions, which scores inside generated code and can be stored."""
    *slopes, intercept = beta
    scaled = ", ".join(scale_columns({c: moments[c] for c in continuous})) or "0 AS none_z"
    known = {**{f"{c}_z": (f"{c}_z", 0.0) for c in continuous}, **{c: (c, 0.0) for c in binary}}
    total = " + ".join([f"{intercept!r}D", *[f"{b!r}D * {n}_known" for n, b in zip(known, slopes)]])
    return LogisticFit(
        PipelineModel(
            [
                SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
                filled(known),
                SQLTransformer(statement=f"SELECT *, 1D / (1D + exp(-({total}))) AS {PROBABILITY} FROM __THIS__"),
            ]
        ),
        [f"{n}_known" for n in known],
        slopes,
        intercept,
        passes,
    )
