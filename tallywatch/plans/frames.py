"""The frames the named queries start from, and their output form."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from tallywatch import schema as S
from tallywatch.functions.exprs import double, stack, text, to_rows
from tallywatch.operators import evaluate as ev, tiers
from tallywatch.operators.features import master_dataset, model_features, model_population
from tallywatch.operators.filters import high_risk, in_split, split_name
from tallywatch.operators.split import Boundaries, find_boundaries
from tallywatch.report import tables as rt
from tallywatch.session import scratch_path
from tallywatch.sinks.writers import write_parquet
from tallywatch.sources import mapped

SCORES = {"hgb_fraud_score": "champion", "logistic_model_b_score": S.CHALLENGER_MODEL}


def output(df: DataFrame, places: int = 6) -> DataFrame:
    """Decimals as doubles, fractions rounded: the form both engines agree on."""
    shaped = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            digits = 4 if isinstance(field.dataType, T.FloatType) else places
            shaped.append(f"round({double(name)}, {digits}) AS {name}")
        else:
            shaped.append(name)
    return df.selectExpr(*shaped)


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return mapped.transactions(spark, folder)


def defective(spark: SparkSession, folder: str) -> DataFrame:
    return mapped.defective(spark, folder)


def master(spark: SparkSession, folder: str) -> DataFrame:
    return master_dataset(transactions(spark, folder))


def population(spark: SparkSession, folder: str) -> DataFrame:
    return model_population(master(spark, folder))


def bounds(spark: SparkSession, folder: str) -> Boundaries:
    return find_boundaries(high_risk(transactions(spark, folder)).select("step"))


class ScoredRun:
    """The scored frames of one query.

    Boundaries, curves and test rows each read the high-risk master rows with
    their own columns only. ``staged`` writes those rows once first, which pays
    where several models are compared and the rows are read many times.
    """

    def __init__(self, spark: SparkSession, folder: str, staged: bool = False) -> None:
        self.spark, self.folder, self.staged = spark, folder, staged
        self._curves: dict[tuple[str, str], DataFrame] = {}

    @cached_property
    def high_risk_rows(self) -> DataFrame:
        made = (tiers.SCORE, "risk_tier", "operational_alert")
        columns = [c for c in tiers.SCORED_COLUMNS if c not in made]
        rows = high_risk(master(self.spark, self.folder)).select(*columns)
        return write_parquet(rows, scratch_path(self.spark, "high_risk")) if self.staged else rows

    @cached_property
    def bounds(self) -> Boundaries:
        return find_boundaries(self.high_risk_rows)

    def rows(self, split: str, scores: dict[str, str] | None = None) -> DataFrame:
        """High-risk master rows of a split with fixed scores."""
        return mapped.with_scores(in_split(self.high_risk_rows, split, *self.bounds), scores or SCORES)

    def curve(self, split: str, model: str = "champion") -> DataFrame:
        if (split, model) not in self._curves:
            rows = self.rows(split, {"score": model}).select("score", "isFraud")
            self._curves[split, model] = ev.score_curve(rows)
        return self._curves[split, model]

    def operating(self, model: str = "champion") -> Column:
        """The validation F2 threshold of a model, as a one-row subquery."""
        return ev.f2_threshold(self.curve("VALIDATION", model)).select("Threshold").scalar()

    @cached_property
    def thresholds(self) -> DataFrame:
        return tiers.fix_thresholds(tiers.threshold_row(self.curve("VALIDATION"), self.operating()))

    def tiered(self) -> DataFrame:
        """Scored test rows with tier and alert."""
        return tiers.with_tiers(self.rows("TEST", {tiers.SCORE: "champion"}), self.thresholds)

    def metrics(self, model: str, name: str) -> DataFrame:
        """Test metrics of a model at its validation threshold."""
        return ev.classification_metrics(self.curve("TEST", model), self.operating(model), name)

    def measured(self, models: dict[str, str]) -> DataFrame:
        """Test metrics of many models, each at its validation threshold; ``models`` maps a shown name to a model.

        All curves are one plan: one reading of the rows, one group-by, one exchange.
        """
        rows = self.high_risk_rows.selectExpr("*", f"{split_name(*self.bounds)} AS split").where("split <> 'TRAIN'")
        columns = {name: f"s{i}" for i, name in enumerate(models)}
        scored = mapped.with_scores(rows, dict(zip(columns.values(), models.values())))
        curves = ev.segmented_curve(ev.unpivoted_scores(scored, columns, ["split", "isFraud"]), ["split", "model"])
        part = lambda split: curves.where(f"split = '{split}'").drop("split")
        return ev.segmented_metrics(part("TEST"), ev.segmented_thresholds(part("VALIDATION")))

    def comparison(self) -> DataFrame:
        """Champion, challenger and rule on the test period."""
        measured = self.measured({CHAMPION_NAME: "champion", CHALLENGER_NAME: S.CHALLENGER_MODEL})
        return ev.model_comparison([measured, ev.rule_metrics(self.rows("TEST"))], with_specificity=False)


# Names of the models in the comparison tables.
CHAMPION_NAME = "HistGradientBoosting - Defensible Features"
CHALLENGER_NAME = "Logistic Regression - Model B"


def curve(spark: SparkSession, folder: str, split: str, model: str = "champion") -> DataFrame:
    return ScoredRun(spark, folder).curve(split, model)


def tiered(spark: SparkSession, folder: str) -> DataFrame:
    return ScoredRun(spark, folder).tiered()


def fact(spark: SparkSession, folder: str) -> DataFrame:
    return rt.fact_table(tiered(spark, folder))


def comparison(spark: SparkSession, folder: str) -> DataFrame:
    return ScoredRun(spark, folder, staged=True).comparison()


def stress_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The four feature-set models on the test period."""
    return ScoredRun(spark, folder, staged=True).measured({model: model for model in S.FEATURE_SETS})


def association(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of every champion feature with the label, and its spread.

    A model-free stand-in of the importance table, computed from the rows.
    """
    names = S.CHAMPION_FEATURES
    rows = model_features(population(spark, folder), names)
    row = rows.selectExpr(
        *[f"abs(corr({double(c)}, {double('isFraud')})) AS {c}_mean" for c in names],
        *[f"stddev_pop({double(c)}) AS {c}_std" for c in names],
    )
    return to_rows(row, names, "feature", {"importance_mean": "{}_mean", "importance_std": "{}_std"})


def coefficient_table(spark: SparkSession, folder: str) -> DataFrame:
    """(Model, Feature, Coefficient) with the correlation inside a split as the
    coefficient: A on train, B on validation, C on test, D on all rows."""
    every = S.FEATURE_SETS["Model_D_Enhanced_PaySim"]
    rows = model_features(population(spark, folder), every[0] + every[1])
    split = split_name(*bounds(spark, folder))
    # The rows each model's column is taken from.
    members = dict(
        zip(S.FEATURE_SETS, [f"{split} = 'TRAIN'", f"{split} = 'VALIDATION'", f"{split} = 'TEST'", "TRUE"])
    )
    labels = [(m, f) for m, (continuous, binary, _) in S.FEATURE_SETS.items() for f in continuous + binary]
    row = rows.selectExpr(
        *[
            f"corr({double(f)}, {double('isFraud')}) FILTER (WHERE {members[m]}) AS c{i}"
            for i, (m, f) in enumerate(labels)
        ]
    )
    cells = [[text(m), text(f), f"c{i}"] for i, (m, f) in enumerate(labels)]
    return row.selectExpr(stack(cells, ["Model", "Feature", "Coefficient"]))


def report_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All eight reporting tables over the fixed scores.

    The scored population is written once; the tables read that stage.
    """
    run = ScoredRun(spark, folder, staged=True)
    rows = write_parquet(tiers.scored_output(run.tiered()), scratch_path(spark, "scored"))
    small = {
        "risk_tier_thresholds": tiers.threshold_table(run.thresholds),
        "risk_tier_summary": tiers.tier_summary(rows),
        "operational_alert_summary": tiers.alert_summary(rows),
        "investigation_capacity_summary": tiers.capacity_summary(rows),
        "model_comparison": run.comparison(),
        "hgb_feature_importance": association(spark, folder),
    }
    return {
        "fact_scored_transactions": rt.fact_table(rows),
        "investigator_alert_queue": rt.queue_table(tiers.evaluation_queue(rows)),
        **{table: rt.small_table(df, table) for table, df in small.items()},
    }
