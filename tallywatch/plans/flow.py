"""The whole run: raw CSV to reporting tables and views.

Each step reads stages written by earlier ones below an output folder and writes
its own, so a step can be repeated alone and a lost executor costs no more than
the step it worked on. Stages: ``raw``, ``master``, ``model_population`` and
``scored`` are tables of rows; everything else is a summary of a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch import schema as S
from tallywatch.models import estimators as es, importance, stress
from tallywatch.models.boosting import load_trees
from tallywatch.operators import evaluate as ev, explore, profile, quality, split as sp, tiers
from tallywatch.operators.compare import coefficient_pivot, delta_pair, delta_vs_baseline, sort_coefficients
from tallywatch.operators.features import master_dataset, model_features, model_population
from tallywatch.operators.filters import in_split, scoring_period
from tallywatch.operators.onepass import one_pass
from tallywatch.plans.frames import CHALLENGER_NAME, CHAMPION_NAME
from tallywatch.report import contracts, tables as rt, views
from tallywatch.sinks.generations import Generations
from tallywatch.sinks.writers import read_stage, write_observed, write_parquet, write_summary_csv
from tallywatch.sources import transactions as src

_EVERY = [c for part in S.FEATURE_SETS["Model_D_Enhanced_PaySim"][:2] for c in part]


class Flow:
    """Steps over one output folder, in the order of the methods."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- stages --------------------------------------------------------------
    def stage(self, name: str) -> DataFrame:
        return read_stage(self.spark, self.folder, name)

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        return write_parquet(df, f"{self.folder}/{name}")

    def _summaries(self, step: str, frames: dict[str, DataFrame]) -> None:
        for name, df in frames.items():
            write_summary_csv(self._put(f"{step}/{name}", df), f"{self.folder}/csv/{step}/{name}")

    # ---- steps ---------------------------------------------------------------
    def land(self, csv_path: str) -> DataFrame:
        """CSV to Parquet, once; later steps prune columns and have row positions."""
        return src.land_csv(self.spark, csv_path, f"{self.folder}/raw")

    def profile(self) -> None:
        """Profile and quality reports: their global measures share one scan."""
        raw = self.stage("raw")
        reports = {
            "overall": profile.overall_profile,
            "missing": profile.missing_values,
            "numeric": profile.numeric_summary,
            "rule": profile.rule_performance,
            "audit": quality.quality_audit,
            "balances": quality.balance_summary,
            "balance_consistency": quality.balance_consistency,
        }
        self._summaries(
            "profile",
            {
                **one_pass(raw, {name: report.summary(raw) for name, report in reports.items()}),
                "types": profile.column_types(raw),
                "by_type": profile.type_profile(raw),
                "prefixes": quality.prefix_summary(raw),
                "high_value": quality.high_value_profile(raw),
            },
        )

    def features(self) -> None:
        """Ids in file order, money as decimals, engineered columns."""
        money = [f"CAST({c} AS DECIMAL(20,2)) AS {c}" if c in S.MONEY_COLUMNS else c for c in S.SOURCE_COLUMNS]
        identified = src.with_transaction_id(self.stage("raw").select("*", "_metadata"))
        master, counted = write_observed(
            master_dataset(identified.selectExpr("transaction_id", *money)), f"{self.folder}/master", explore.MASTER_MEASURES
        )
        model, modelled = write_observed(model_population(master), f"{self.folder}/model_population", explore.MODEL_MEASURES)
        source = self.stage("raw").selectExpr(*[f"{e} AS {n}" for n, e in explore.SOURCE_MEASURES.items()]).first().asDict()
        self._summaries("features", {"validation": explore.dataset_validation(source | counted | modelled, master, model)})

    def explore(self) -> None:
        """Two scans of the master table: global measures, and the group table."""
        master = self.stage("master")
        reports = {"classes": explore.class_summary, "flags": explore.flag_lift}
        groups = explore.group_table(master)
        self._summaries(
            "explore",
            {
                **one_pass(master, {name: report.summary(master) for name, report in reports.items()}),
                "types": explore.type_summary(groups),
                "hours": explore.hourly_summary(groups),
                "days": explore.daily_summary(groups),
                "amount_bands": explore.amount_band_summary(groups),
            },
        )

    def prepare(self) -> sp.Boundaries:
        """Population summaries and the chronological split."""
        model = self.stage("model_population")
        bounds = sp.find_boundaries(model)
        summaries = {
            "population": explore.population_summary.summary(model),
            "missing": profile.missing_values.summary(model, S.MODEL_COLUMNS, "Feature", "Missing_Pct"),
            "infinite": explore.feature_infinite.summary(model),
            "flags": explore.flag_lift.summary(model, key="Feature", when=""),
            "fixed_split": explore.fixed_split_summary.summary(model),
        }
        self._summaries(
            "prepare",
            {
                **one_pass(model, summaries),
                "types": explore.high_risk_type_summary(model),
                "numeric": explore.numeric_by_class(model),
                "variation": explore.feature_variation(model),
                "split": sp.split_summary(model, bounds),
            },
        )
        return bounds

    def _splits(self) -> dict[str, DataFrame]:
        """Model rows per split, after checking them against the record."""
        recorded = self.stage("prepare/split")
        bounds = sp.recorded_boundaries(recorded)
        model = quality.leakage_guard(self.stage("model_population"))
        contracts.require_split_contract(contracts.split_contract(sp.split_summary(model, bounds), recorded))
        rows = model_features(model, _EVERY)
        return {name: in_split(rows, name, *bounds) for name in sp.SPLITS}

    def _rule(self) -> DataFrame:
        after = sp.recorded_boundaries(self.stage("prepare/split")).validation_end
        return ev.rule_metrics(scoring_period(self.stage("master"), after))

    def _scored(self, stage: str, parts: dict[str, DataFrame], models: dict[str, es.Model]) -> dict[str, DataFrame]:
        """Validation and test rows with the models' scores, written once.

        Curves, thresholds and predictions read the scores from there, so no row
        is scored twice.
        """
        rows = None
        for split in ("VALIDATION", "TEST"):
            part = parts[split].selectExpr("*", f"'{split}' AS split")
            rows = part if rows is None else rows.unionByName(part)
        for column, model in models.items():
            rows = es.score(model, rows, column)
        stored = self._put(stage, rows.select("transaction_id", "step", "isFraud", "split", *models))
        return {s: stored.where(f"split = '{s}'") for s in ("VALIDATION", "TEST")}

    def baseline(self, iterations: int = 500) -> None:
        """Baseline regression: threshold from validation, metrics on test."""
        parts = self._splits()
        model = es.fit_logistic(parts["TRAIN"], S.CONTINUOUS_FEATURES, S.BASELINE_BINARY, iterations)
        es.save_model(model, f"{self.folder}/models/baseline")
        scored = self._scored("baseline/scored", parts, {"fraud_score": model})
        validation, test = (ev.score_curve(scored[s], "fraud_score") for s in ("VALIDATION", "TEST"))
        cut = ev.f2_threshold(validation).first()["Threshold"]
        name = "Logistic Regression"
        rows = [
            ev.classification_metrics(test, 0.50, f"{name} - 0.50 Threshold"),
            ev.classification_metrics(test, cut, f"{name} - Validation F2 Threshold"),
            self._rule(),
        ]
        coefficients = es.coefficient_table(
            parts["TRAIN"], model, "baseline", S.CONTINUOUS_FEATURES, S.BASELINE_BINARY
        )
        self._summaries(
            "baseline",
            {
                "comparison": ev.model_comparison(rows),
                "top_thresholds": ev.top_thresholds(validation),
                "tradeoff": ev.threshold_tradeoff(validation),
                "coefficients": sort_coefficients(coefficients.drop("Model")),
            },
        )
        self._put("baseline/pr_curve", ev.pr_curve(validation).drop("place", "points"))
        self._put("baseline/roc_curve", ev.roc_curve(test))
        cuts = {"predicted_fraud_050": ("fraud_score", 0.50), "predicted_fraud_selected": ("fraud_score", cut)}
        self._put("baseline/test_predictions", ev.predictions(scored["TEST"], cuts).drop("split"))

    def stress(self, iterations: int = 700) -> None:
        """Four feature sets on the same split."""
        result = stress.stress_test(*self._splits().values(), iterations)
        for name, model in result.models.items():
            es.save_model(model, f"{self.folder}/models/{name.lower()}")
        comparison = self._put("stress/comparison", result.comparison)
        write_summary_csv(comparison, f"{self.folder}/csv/stress/comparison")
        self._summaries(
            "stress",
            {
                "coefficients": result.coefficients,
                "coefficient_stability": coefficient_pivot(result.coefficients),
                "delta_vs_baseline": delta_vs_baseline(comparison),
                "feature_sets": stress.feature_register(self.spark),
            },
        )

    def champion(self, iterations: int = 200) -> None:
        """Boosted trees against the second feature set and the rule."""
        parts = self._splits()
        model = es.fit_boosted_trees(parts["TRAIN"], iterations=iterations)
        model.save(self.spark, f"{self.folder}/models/champion")
        challenger = es.load_model(f"{self.folder}/models/{S.CHALLENGER_MODEL.lower()}")
        scored = self._scored(
            "champion/scored", parts, {tiers.SCORE: model, "logistic_model_b_score": challenger}
        )
        validation = ev.score_curve(scored["VALIDATION"], tiers.SCORE)
        cut = ev.f2_threshold(validation).first()["Threshold"]
        stored = self.stage("stress/comparison").where(f"Model = '{S.CHALLENGER_MODEL}'").first()
        cuts = {
            "hgb_predicted_fraud": (tiers.SCORE, cut),
            "logistic_model_b_predicted": ("logistic_model_b_score", stored["Validation_Threshold"]),
        }
        metrics = [
            ev.classification_metrics(ev.score_curve(scored["TEST"], column), threshold, name)
            for (column, threshold), name in zip(cuts.values(), (CHAMPION_NAME, CHALLENGER_NAME))
        ]
        comparison = ev.model_comparison([*metrics, self._rule()], with_specificity=False)
        self._summaries(
            "champion",
            {
                "comparison": comparison,
                "top_thresholds": ev.top_thresholds(validation),
                "delta": delta_pair(comparison, CHAMPION_NAME, CHALLENGER_NAME),
                "importance": importance.permutation_importance(model, parts["VALIDATION"]),
            },
        )
        self._put("champion/test_predictions", ev.predictions(scored["TEST"], cuts).drop("split"))

    def risk(self) -> None:
        """Tiers, alerts, queue and capacity over the scored test period."""
        bounds = sp.recorded_boundaries(self.stage("prepare/split"))
        model = load_trees(self.spark, f"{self.folder}/models/champion")
        master = self.stage("master")
        made = {*S.CHAMPION_FEATURES, "isFraud", tiers.SCORE, "risk_tier", "operational_alert"}
        kept = tuple(c for c in tiers.SCORED_COLUMNS if c not in made)

        validation = self.stage("champion/scored").where("split = 'VALIDATION'")
        curve = ev.score_curve(validation, tiers.SCORE)
        operating = self.stage("champion/comparison").where("contains(Model, 'HistGradientBoosting')").first()
        cuts = tiers.fix_thresholds(tiers.threshold_row(curve, operating["Threshold"]))
        rows = model_features(scoring_period(master, bounds.validation_end), S.CHAMPION_FEATURES, kept)
        test = tiers.with_tiers(es.score(model, rows, tiers.SCORE), cuts)
        rows = self._put("scored", tiers.scored_output(test))
        queue = self._put("queue_evaluation", tiers.evaluation_queue(rows))
        self._put("queue", tiers.investigator_queue(queue))
        self._summaries(
            "risk",
            {
                "thresholds": tiers.threshold_table(cuts),
                "tiers": tiers.tier_summary(rows),
                "alerts": tiers.alert_summary(rows),
                "capacity": tiers.capacity_summary(rows),
                "top_100": tiers.top_alerts(rows),
            },
        )

    def report(self) -> dict[str, DataFrame]:
        """Load the eight reporting tables as one generation, checked before it is published, and register the ten views.

        The checks of the load are kept as summaries. A broken rule raises, and the
        views and tables of the load before stay.
        """
        small = {
            "risk_tier_thresholds": "risk/thresholds",
            "risk_tier_summary": "risk/tiers",
            "operational_alert_summary": "risk/alerts",
            "investigation_capacity_summary": "risk/capacity",
            "model_comparison": "champion/comparison",
            "hgb_feature_importance": "champion/importance",
        }
        frames = {
            "fact_scored_transactions": rt.fact_table(self.stage("scored")),
            "investigator_alert_queue": rt.queue_table(self.stage("queue")),
            **{table: rt.small_table(self.stage(stage), table) for table, stage in small.items()},
        }
        loads = Generations(self.spark, f"{self.folder}/reporting")
        tables = loads.load(frames, contracts.require_constraints)
        made = views.create_views(self.spark, tables)
        self._summaries("report", {**contracts.load_report(tables), "views": contracts.view_smoke(self.spark, made)})
        return tables

    def run(self, csv_path: str, trees: int = 200) -> dict[str, DataFrame]:
        self.land(csv_path)
        self.profile()
        self.features()
        self.explore()
        self.prepare()
        self.baseline()
        self.stress()
        self.champion(trees)
        self.risk()
        return self.report()
