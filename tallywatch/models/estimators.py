"""Fitting, scoring and storing the two kinds of model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tallywatch import schema as S
from tallywatch.functions.exprs import double, odds_ratio, text
from tallywatch.models.boosting import BoostedTrees, Rules, fit_trees
from tallywatch.models.newton import PROBABILITY, LogisticFit, fit_sets
from tallywatch.models.scaling import class_weights
from tallywatch.operators.quality import leakage_guard

Model = PipelineModel | LogisticFit | BoostedTrees


def fit_logistic(train: DataFrame, continuous: list[str], binary: list[str], iterations: int = 500) -> LogisticFit:
    """Balanced, L2-regularised logistic regression on standardised columns; see ``newton``."""
    leakage_guard(train)
    return fit_sets(train, {"model": (continuous, binary)}, iterations)["model"]


def fit_boosted_trees(
    train: DataFrame, features: list[str] = S.CHAMPION_FEATURES, iterations: int = 200, rules: Rules = Rules()
) -> BoostedTrees:
    """Gradient-boosted trees with balanced weights: 0.08 step, 31 leaves, at least 100 rows per leaf, L2 of 1.

    Grown best leaf first on 255 bins (see ``boosting``). Missing features have a
    bin of their own. Rows without a label are left out.
    """
    leakage_guard(train)
    classes = class_weights(train).take(3)
    if len(classes) > 2 or {r["isFraud"] for r in classes} - {0, 1}:
        raise ValueError("isFraud has other values than 0 and 1")
    weight = {r["isFraud"]: r["weight"] for r in classes}
    return fit_trees(train, features, (weight.get(0, 1.0), weight.get(1, 1.0)), iterations, rules)


def score(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """The frame with the fraud probability; helper columns are dropped."""
    return getattr(model, "pipeline", model).transform(df).selectExpr(*df.columns, f"{PROBABILITY} AS {name}")


def save_model(model: LogisticFit, path: str) -> str:
    """Regressions; trees have a ``save`` of their own."""
    model.pipeline.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficient_table(df: DataFrame, model: LogisticFit, name: str, continuous: list[str], binary: list[str]) -> DataFrame:
    """Coefficient, odds ratio (clipped at e^20) and absolute value per feature."""
    labels = [f"continuous__{c}" for c in continuous] + [f"binary__{c}" for c in binary]
    rows = df.sparkSession.createDataFrame(list(zip(labels, model.coefficients)), "Feature string, Coefficient double")
    return rows.selectExpr(
        f"{text(name)} AS Model",
        "Feature",
        "Coefficient",
        f"{odds_ratio('Coefficient')} AS Odds_Ratio",
        f"abs({double('Coefficient')}) AS Absolute_Coefficient",
    )
