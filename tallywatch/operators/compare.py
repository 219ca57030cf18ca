"""Deltas between model rows and other reshaping of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import any_of, double, stack, text

# Metrics of the pair comparison, in order.
PAIR_METRICS = [
    "ROC_AUC", "Average_Precision", "Precision", "Recall", "F1", "F2", "True_Positive",
    "False_Positive", "False_Negative", "Alerts", "Alert_Rate_Pct",
]
# Output column of each delta against the baseline model.
BASELINE_DELTAS = {
    "ROC_AUC_Delta_vs_A": "ROC_AUC",
    "Average_Precision_Delta_vs_A": "Average_Precision",
    "Precision_Delta_vs_A": "Precision",
    "Recall_Delta_vs_A": "Recall",
    "F2_Delta_vs_A": "F2",
    "Alert_Rate_Delta_vs_A": "Alert_Rate_Pct",
    "True_Positive_Delta_vs_A": "True_Positive",
    "False_Positive_Delta_vs_A": "False_Positive",
}


def delta_vs_baseline(comparison: DataFrame, baseline: str = S.BASELINE_MODEL) -> DataFrame:
    """Every model minus the baseline row.

    The table has one row per model; a window over it hands the baseline to
    each row without reading the table twice.
    """
    base = lambda c: f"first_value(CASE WHEN Model = {text(baseline)} THEN {c} END, TRUE) OVER ()"
    return comparison.selectExpr(
        "Model", *[f"{c} - {base(c)} AS {out}" for out, c in BASELINE_DELTAS.items()]
    )


def delta_pair(comparison: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Eleven metrics in long form: champion, challenger and difference."""
    rows = [[text(m), double(m)] for m in PAIR_METRICS]
    long = comparison.where(any_of("Model", [champion, challenger])).selectExpr(
        "Model", stack(rows, ["Metric", "value"])
    )
    value = lambda name: f"MAX(value) FILTER (WHERE Model = {text(name)})"
    sides = long.groupBy("Metric").agg(
        F.expr(f"{value(champion)} AS HGB_Value"), F.expr(f"{value(challenger)} AS Model_B_Value")
    )
    return sides.selectExpr("*", "HGB_Value - Model_B_Value AS HGB_Minus_Model_B")


def coefficient_pivot(coefficients: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Feature by model. The model list is given, so no pass looks for it."""
    models = models or list(S.FEATURE_SETS)
    return coefficients.groupBy("Feature").pivot("Model", models).agg(F.expr("first(Coefficient)"))


def sort_models(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.desc("F2"), F.asc("Model"))


def sort_models_by_recall(comparison: DataFrame) -> DataFrame:
    """Highest recall first, models without recall last."""
    return comparison.orderBy(F.desc_nulls_last("Recall"), F.asc("Model"))


def sort_coefficients(coefficients: DataFrame) -> DataFrame:
    return coefficients.orderBy(F.desc("Absolute_Coefficient"), F.asc("Feature"))


def sort_types_by_rate(types: DataFrame) -> DataFrame:
    return types.orderBy(F.desc("Fraud_Rate_Pct"), F.asc("Transaction_Type"))
