"""Named queries that fit or use a model. Fitted results are checked by rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch import schema as S
from tallywatch.models import boosting, estimators as es, importance, scaling, stress
from tallywatch.models.boosting import BoostedTrees, load_trees
from tallywatch.models.newton import PROBABILITY
from tallywatch.operators import evaluate as ev
from tallywatch.operators.features import model_features
from tallywatch.operators.filters import in_split
from tallywatch.operators.split import find_boundaries
from tallywatch.plans import frames as fr
from tallywatch.plans.catalog import query
from tallywatch.plans.frames import output
from tallywatch.session import scratch_path
from tallywatch.sinks.writers import write_parquet
from tallywatch.sources import mapped

_EVERY = [c for part in S.FEATURE_SETS["Model_D_Enhanced_PaySim"][:2] for c in part]
_champions: dict[tuple, str] = {}  # where the champion of some input files is stored


def _splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Model features written once, then one frame per split."""
    features = model_features(fr.population(spark, folder), _EVERY)
    rows = write_parquet(features, scratch_path(spark, "model_features"))
    cut = find_boundaries(rows)
    return {name: in_split(rows, name, *cut) for name in ("TRAIN", "VALIDATION", "TEST")}


def _version(spark: SparkSession, folder: str) -> tuple:
    """Files, sizes and times of the tables a model is fitted on."""
    seen = []
    for name, columns in (("orders", mapped.ORDERS), ("customer", mapped.CUSTOMERS)):
        files = spark.read.schema(columns).parquet(f"{folder}/{name}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        seen += sorted(map(tuple, files.distinct().collect()))
    return tuple(seen)


def _champion(spark: SparkSession, folder: str, train: DataFrame) -> BoostedTrees:
    """The champion over the train rows of the folder's present files, fitted once and read back from its stage."""
    key = (spark.sparkContext.applicationId, *_version(spark, folder))
    if key not in _champions:
        _champions[key] = es.fit_boosted_trees(train).save(spark, scratch_path(spark, "champion"))
    return load_trees(spark, _champions[key])


@query("m_scale")
def _(spark, folder):
    parts = _splits(spark, folder)
    moments = scaling.scaling_moments(parts["TRAIN"], S.CONTINUOUS_FEATURES)
    rows = parts["TRAIN"].unionByName(parts["VALIDATION"]).unionByName(parts["TEST"])
    return output(rows.selectExpr("transaction_id", *scaling.scale_columns(moments)))


@query("m_class_weight")
def _(spark, folder):
    return output(scaling.class_weights(_splits(spark, folder)["TRAIN"]))


@query("m_logistic")
def _(spark, folder):
    """Scored test rows of the baseline regression."""
    parts = _splits(spark, folder)
    model = es.fit_logistic(parts["TRAIN"], S.CONTINUOUS_FEATURES, S.BASELINE_BINARY)
    return output(es.score(model, parts["TEST"], "fraud_score").select("transaction_id", "step", "isFraud", "fraud_score"))


@query("m_logistic_check")
def _(spark, folder):
    """The gradient of the penalised loss at the solution, per feature and three places: all 0."""
    train = _splits(spark, folder)["TRAIN"]
    model = es.fit_logistic(train, S.CONTINUOUS_FEATURES, S.BASELINE_BINARY)
    weighted, count = scaling.with_class_weight(train)
    scored = model.pipeline.transform(weighted).withColumnRenamed(PROBABILITY, "p")
    row = scored.selectExpr(*[f"SUM(weight * (p - isFraud) * {n}) / SUM(weight) AS g{i}" for i, n in enumerate(model.features)])
    slopes = [b / count for b in model.coefficients]
    listed = ", ".join(f"struct('{n}' AS feature, round(g{i} + {slopes[i]!r}D, 3) + 0D AS gradient)" for i, n in enumerate(model.features))
    return row.selectExpr(f"inline(array({listed}))")


@query("m_score_check")
def _(spark, folder):
    """Test rows per label, and how many of them have a champion score within [0, 1]."""
    parts = _splits(spark, folder)
    scored = es.score(_champion(spark, folder, parts["TRAIN"]), parts["TEST"])
    return scored.groupBy("isFraud").agg(F.expr("COUNT(*) AS row_count"), F.expr("COUNT_IF(score BETWEEN 0 AND 1) AS in_range"))


@query("m_coefficients")
def _(spark, folder):
    train = _splits(spark, folder)["TRAIN"]
    model = es.fit_logistic(train, S.CONTINUOUS_FEATURES, S.BASELINE_BINARY)
    return output(es.coefficient_table(train, model, "baseline", S.CONTINUOUS_FEATURES, S.BASELINE_BINARY))


@query("m_feature_sets")
def _(spark, folder):
    return output(stress.stress_test(*_splits(spark, folder).values()).comparison)


@query("m_gbt_root")
def _(spark, folder):
    """Per feature the bins, the best first split of the first tree and its gain."""
    train = _splits(spark, folder)["TRAIN"]
    weight = {r["isFraud"]: r["weight"] for r in scaling.class_weights(train).take(2)}
    return output(boosting.first_splits(train, S.CHAMPION_FEATURES, (weight[0], weight[1])), 4)


@query("m_gbt")
def _(spark, folder):
    """Champion metrics on the test period at its validation threshold."""
    parts = _splits(spark, folder)
    model = _champion(spark, folder, parts["TRAIN"])
    curve = lambda rows: ev.score_curve(es.score(model, rows).select("score", "isFraud"))
    cut = ev.f2_threshold(curve(parts["VALIDATION"])).select("Threshold").scalar()
    return output(ev.classification_metrics(curve(parts["TEST"]), cut, fr.CHAMPION_NAME))


@query("m_score")
def _(spark, folder):
    parts = _splits(spark, folder)
    model = _champion(spark, folder, parts["TRAIN"])
    return output(es.score(model, parts["TEST"], "hgb_fraud_score").select("transaction_id", "hgb_fraud_score"))


@query("m_save")
def _(spark, folder):
    """Rows per label, and the largest difference between the scores of the stored and of the fitted champion."""
    parts = _splits(spark, folder)
    model, rows = _champion(spark, folder, parts["TRAIN"]), parts["TEST"]
    stored = load_trees(spark, model.save(spark, scratch_path(spark, "champion_copy")))
    both = es.score(stored, es.score(model, rows, "direct"), "reloaded")
    return output(both.groupBy("isFraud").agg(F.expr("COUNT(*) AS row_count"), F.expr("MAX(abs(direct - reloaded)) AS largest_difference")))


@query("e_permutation_importance")
def _(spark, folder):
    parts = _splits(spark, folder)
    model = _champion(spark, folder, parts["TRAIN"])
    return output(importance.permutation_importance(model, parts["VALIDATION"]))
