"""The four feature sets, fitted together on one split and compared at their own thresholds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tallywatch import schema as S
from tallywatch.models.estimators import coefficient_table, score
from tallywatch.models.newton import LogisticFit, fit_sets
from tallywatch.operators import evaluate as ev
from tallywatch.operators.compare import sort_models
from tallywatch.operators.quality import leakage_guard


class Stress(NamedTuple):
    models: dict[str, LogisticFit]
    comparison: DataFrame
    coefficients: DataFrame


def feature_register(spark: SparkSession) -> DataFrame:
    """Model, feature, kind and purpose of every feature-set member."""
    rows = [
        (model, feature, kind, purpose)
        for model, (continuous, binary, purpose) in S.FEATURE_SETS.items()
        for kind, names in (("Continuous", continuous), ("Binary", binary))
        for feature in names
    ]
    return spark.createDataFrame(rows, "Model string, Feature string, Feature_Type string, Purpose string")


def stress_test(train: DataFrame, validation: DataFrame, test: DataFrame, iterations: int = 700, names: list[str] | None = None) -> Stress:
    """Fit the sets in shared passes, pick thresholds on validation, measure on test, best F2 first.

    Every later row is scored once by all models, and all curves are one plan.
    """
    sets = {name: S.FEATURE_SETS[name][:2] for name in names or S.FEATURE_SETS}
    columns = [*dict.fromkeys(c for part in sets.values() for c in part[0] + part[1]), "isFraud"]
    leakage_guard(train.select(*columns))
    models = fit_sets(train, sets, iterations)
    rows = validation.selectExpr(*columns, "'VALIDATION' AS split").unionByName(test.selectExpr(*columns, "'TEST' AS split"))
    scores = {name: f"s{i}" for i, name in enumerate(sets)}
    for name, column in scores.items():
        rows = score(models[name], rows, column)
    curves = ev.segmented_curve(ev.unpivoted_scores(rows, scores, ["split", "isFraud"]), ["split", "model"])
    part = lambda split: curves.where(f"split = '{split}'").drop("split")
    cuts = ev.segmented_thresholds(part("VALIDATION"))
    counts = " ".join(f"WHEN '{name}' THEN {len(a) + len(b)}" for name, (a, b) in sets.items())
    chosen = cuts.selectExpr("model AS Model", "Precision AS Validation_Precision", "Recall AS Validation_Recall", "F2 AS Validation_F2")
    comparison = ev.segmented_metrics(part("TEST"), cuts).join(chosen, "Model").selectExpr(
        "Model",
        f"CASE Model {counts} END AS Feature_Count",
        "Threshold AS Validation_Threshold",
        "Validation_Precision", "Validation_Recall", "Validation_F2",
        "ROC_AUC", "Average_Precision", "Accuracy", "Precision", "Recall", "F1", "F2",
        "True_Negative", "False_Positive", "False_Negative", "True_Positive", "Alerts",
        "Alert_Rate_Pct", "False_Positive_Rate_Pct",
    )
    tables = [coefficient_table(train, models[name], name, *sets[name]) for name in sets]
    return Stress(models, sort_models(comparison), ev.model_comparison(tables))
