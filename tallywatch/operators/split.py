"""Row-balanced chronological split."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.exprs import double, percent_or_zero, total
from tallywatch.operators.explore import dense
from tallywatch.operators.filters import INVALID_STEP, split_name

TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.10
# Split names in order.
SPLITS = ["TRAIN", "VALIDATION", "TEST"]


class Boundaries(NamedTuple):
    train_end: int
    validation_end: int


def step_profile(model: DataFrame) -> DataFrame:
    """Rows per step with running count and share.

    The windows have no partition key, but run over one row per simulated hour
    (743 of them here), after the rows were counted.
    """
    counts = model.where("step IS NOT NULL").groupBy("step").agg(F.expr("COUNT(*) AS row_count"))
    return counts.selectExpr(
        "step",
        "row_count",
        "SUM(row_count) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_rows",
        "SUM(row_count) OVER () AS total_rows",
    ).selectExpr("*", f"{double('cumulative_rows')} / {double('total_rows')} AS cumulative_pct")


def split_boundaries(
    profile: DataFrame, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE
) -> DataFrame:
    """One row: the last train and validation steps.

    The step whose running count is nearest to the target; the first on ties.
    Validation is searched only after the train boundary.
    """
    nearest = lambda share: (
        f"MIN(struct(abs({double('cumulative_rows')} - {double('total_rows')} * {share!r}D) AS gap, step)).step"
    )
    train_end = profile.selectExpr(f"{nearest(train)} AS train_end")
    later = profile.where(F.expr("step") > train_end.scalar())
    return later.selectExpr(f"{nearest(train + validation)} AS validation_end").select(
        train_end.scalar().alias("train_end"), "validation_end"
    )


def find_boundaries(model: DataFrame, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE) -> Boundaries:
    """The two steps as numbers, so that they are pushed down as literals.

    Rows are counted per valid step on the cluster; the profile that comes back
    has one row per simulated hour. With one step only, that step ends both the
    train and the validation period; with none, nothing is to be split and it raises.
    """
    counts = model.where(f"NOT {INVALID_STEP}").groupBy("step").count().collect()
    if not counts:
        raise ValueError("no row has a valid step")
    rows, done, profile = sum(r["count"] for r in counts), 0, []
    for step, count in sorted((r["step"], r["count"]) for r in counts):
        done += count
        profile.append((step, done))
    nearest = lambda pairs, share: min(pairs, key=lambda p: (abs(p[1] - rows * share), p[0]))[0]
    train_end = nearest(profile, train)
    later = [p for p in profile if p[0] > train_end] or [(train_end, rows)]
    return Boundaries(train_end, nearest(later, train + validation))


def with_split(df: DataFrame, bounds: Boundaries) -> DataFrame:
    return df.selectExpr("*", f"{split_name(*bounds)} AS split")


def split_summary(model: DataFrame, bounds: Boundaries) -> DataFrame:
    """Rows, share, fraud, rate and step range of the three splits."""
    parts = model.groupBy(F.expr(f"{split_name(*bounds)} AS Split")).agg(
        F.expr("COUNT(*) AS n"),
        F.expr(f"{total('CAST(isFraud AS BIGINT)')} AS fraud"),
        F.expr("MIN(step) AS first_step"),
        F.expr("MAX(step) AS last_step"),
    )
    return dense(parts, SPLITS, "Split").selectExpr(
        "Split",
        "COALESCE(n, 0) AS Rows",
        f"{percent_or_zero('n', 'SUM(n) OVER ()')} AS Population_Pct",
        "COALESCE(fraud, 0) AS Fraud_Count",
        f"{percent_or_zero('fraud', 'n')} AS Fraud_Rate_Pct",
        "CAST(first_step AS INT) AS Minimum_Step",
        "CAST(last_step AS INT) AS Maximum_Step",
    )


def recorded_boundaries(stored_summary: DataFrame) -> Boundaries:
    """Boundaries read back from a stored split summary."""
    last = {r["Split"]: r["Maximum_Step"] for r in stored_summary.select("Split", "Maximum_Step").take(3)}
    return Boundaries(int(last["TRAIN"]), int(last["VALIDATION"]))
