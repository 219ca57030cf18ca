"""Named queries, one per operator. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch import schema as S
from tallywatch.functions import exprs as ex
from tallywatch.operators import compare, evaluate as ev, explore, features, filters as flt
from tallywatch.operators.features import model_population
from tallywatch.operators import ordering, profile, quality, split as sp, tiers
from tallywatch.plans import frames as fr
from tallywatch.plans.frames import output
from tallywatch.report import contracts, tables as rt, views
from tallywatch.session import scratch_path
from tallywatch.sinks import writers
from tallywatch.sinks.generations import Generations
from tallywatch.sources import mapped, transactions as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _stamp(df: DataFrame) -> DataFrame:
    """Row count, key sum and money sum of a table read back from storage."""
    return output(
        df.selectExpr("COUNT(*) AS row_count", "SUM(transaction_id) AS id_sum", "SUM(amount) AS amount_sum")
    )


# ---- scans, sources and sinks ----------------------------------------------
def _csv(spark: SparkSession, folder: str, in_order: bool = False) -> str:
    """The raw file; its lines stand in no order, or in order of the transaction id."""
    path, rows = scratch_path(spark, "transactions_csv"), mapped.transactions(spark, folder)
    writers.write_csv((rows.orderBy("transaction_id") if in_order else rows).select(*S.SOURCE_COLUMNS), path)
    return path


@query("src_csv_sample")
def _(spark, folder):
    return output(src.read_csv_sample(spark, _csv(spark, folder, in_order=True)))


@query("src_csv_full")
def _(spark, folder):
    return output(src.read_csv(spark, _csv(spark, folder)))


@query("src_line_count")
def _(spark, folder):
    return src.line_count(spark, _csv(spark, folder))


@query("src_parquet_projected")
def _(spark, folder):
    return output(src.read_parquet(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_totalprice"]))


@query("src_parquet_rowcount")
def _(spark, folder):
    return src.parquet_row_count(spark, f"{folder}/orders.parquet")


@query("src_head")
def _(spark, folder):
    return output(src.head_rows(fr.master(spark, folder)))


@query("src_stage_output")
def _(spark, folder):
    model = fr.population(spark, folder)
    stage = scratch_path(spark, "stages")
    summary = sp.split_summary(model, sp.find_boundaries(model))
    writers.write_stages({"temporal_split_summary": summary}, stage)
    stored = writers.read_stage(spark, stage, "temporal_split_summary")
    return stored.where("Split = 'VALIDATION'").select("Split", "Rows", "Maximum_Step")


@query("sink_parquet")
def _(spark, folder):
    return _stamp(writers.write_parquet(fr.master(spark, folder), scratch_path(spark, "master")))


@query("sink_csv")
def _(spark, folder):
    path = scratch_path(spark, "type_summary_csv")
    writers.write_summary_csv(output(explore.type_summary(fr.master(spark, folder))), path)
    schema = "Transaction_Type string, Transaction_Count long, Transaction_Value double, " \
        "Average_Transaction_Amount double, Fraud_Count long, Fraud_Value double, " \
        "Average_Fraud_Amount double, Fraud_Rate_Pct double, Fraud_Value_Share_Pct double"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("sink_overwrite")
def _(spark, folder):
    path = scratch_path(spark, "model_population")
    writers.write_parquet(fr.master(spark, folder).select(*S.MODEL_COLUMNS), path)
    return _stamp(writers.write_parquet(fr.population(spark, folder), path))


@query("sink_table_copy")
def _(spark, folder):
    columns = ["transaction_id", "step", "transaction_type", "amount", "legacy_rule_flag"]
    rows = fr.transactions(spark, folder).withColumnsRenamed(rt.TRANSACTION_NAMES).select(*columns)
    return output(writers.write_parquet(rows, scratch_path(spark, "copied_table")))


@query("sink_truncate_reload")
def _(spark, folder):
    """All eight tables as one published generation."""
    loads = Generations(spark, scratch_path(spark, "reporting"))
    frames = fr.report_frames(spark, folder)
    loads.load(frames)
    return contracts.row_counts(loads.tables(list(frames)))


@query("sink_fact_load")
def _(spark, folder):
    return output(writers.write_table(fr.fact(spark, folder), "fact_scored_transactions", scratch_path(spark, "fact")))


@query("sink_queue_load")
def _(spark, folder):
    queue = rt.queue_table(tiers.evaluation_queue(fr.tiered(spark, folder)))
    return output(writers.write_table(queue, "investigator_alert_queue", scratch_path(spark, "queue")))


@query("sink_small_table")
def _(spark, folder):
    summary = tiers.tier_summary(fr.tiered(spark, folder))
    return output(rt.small_table(summary, "risk_tier_summary"))


# ---- projections -----------------------------------------------------------
@query("f_transaction_id")
def _(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return src.with_transaction_id(orders.select("o_orderkey", "_metadata")).select("transaction_id", "o_orderkey")


def _feature(name: str, column: str) -> None:
    @query(name)
    def _(spark, folder):
        return output(fr.master(spark, folder).select("transaction_id", column))


for _name, _column in {
    "f_transaction_day": "transaction_day",
    "f_hour_of_day": "hour_of_day",
    "f_log_amount": "log_amount",
    "f_zero_amount_flag": "zero_amount_flag",
    "f_high_value_flag": "high_value_200k_flag",
    "f_origin_zero_flag": "origin_zero_before_flag",
    "f_dest_zero_flag": "destination_zero_before_flag",
    "f_amount_exceeds_flag": "amount_exceeds_origin_balance_flag",
    "f_dest_merchant": "destination_is_merchant",
    "f_ratio_origin": "amount_to_origin_balance_ratio",
    "f_ratio_dest": "amount_to_destination_balance_ratio",
    "f_balance_error": "origin_balance_error_abs",
    "f_balance_mismatch": "origin_balance_mismatch_flag",
}.items():
    _feature(_name, _column)


@query("f_narrow_types")
def _(spark, folder):
    return fr.master(spark, folder).select("transaction_id", "isFraud", "isFlaggedFraud")


@query("p_master")
def _(spark, folder):
    return output(fr.master(spark, folder))


@query("p_model_columns")
def _(spark, folder):
    return output(fr.population(spark, folder))


def _model_feature(name: str, columns: list[str]) -> None:
    @query(name)
    def _(spark, folder):
        rows = features.model_features(fr.population(spark, folder), columns)
        return output(rows.select("transaction_id", *columns))


_model_feature("f_type_transfer", ["type_transfer_flag"])
_model_feature("f_log_balances", ["log_oldbalanceOrg", "log_oldbalanceDest"])
_model_feature("f_hour_cyclic", ["hour_sin", "hour_cos"])


@query("p_model_features")
def _(spark, folder):
    continuous, binary, _ = S.FEATURE_SETS["Model_D_Enhanced_PaySim"]
    return output(features.model_features(fr.population(spark, folder), continuous + binary))


@query("f_amount_band")
def _(spark, folder):
    rows = fr.transactions(spark, folder)
    return rows.selectExpr("transaction_id", f"{ex.amount_band('amount')} AS amount_band")


@query("f_id_prefix")
def _(spark, folder):
    rows = fr.transactions(spark, folder)
    return rows.selectExpr(
        "transaction_id", f"{ex.prefix('nameOrig')} AS origin_prefix", f"{ex.prefix('nameDest')} AS destination_prefix"
    )


@query("f_risk_tier")
def _(spark, folder):
    return fr.tiered(spark, folder).select("transaction_id", "risk_tier")


@query("f_operational_alert")
def _(spark, folder):
    return fr.tiered(spark, folder).select("transaction_id", "operational_alert")


@query("f_predictions")
def _(spark, folder):
    champion, challenger = "hgb_fraud_score", "logistic_model_b_score"
    run = fr.ScoredRun(spark, folder)
    chosen = lambda model: ev.f2_threshold(run.curve("VALIDATION", model)).first()["Threshold"]
    cuts = {
        "hgb_predicted_fraud": (champion, chosen("champion")),
        "logistic_model_b_predicted": (challenger, chosen(S.CHALLENGER_MODEL)),
        "predicted_fraud_050": (champion, 0.50),
    }
    test = run.rows("TEST")
    return output(
        ev.predictions(test, cuts).select("transaction_id", "step", "isFraud", champion, challenger, *cuts)
    )


@query("f_priority_band")
def _(spark, folder):
    return tiers.evaluation_queue(fr.tiered(spark, folder)).select(
        "investigation_rank", "transaction_id", "risk_tier", "priority_band"
    )


@query("f_recommended_action")
def _(spark, folder):
    rows = flt.alerts(fr.tiered(spark, folder))
    return rows.selectExpr("transaction_id", f"{ex.recommended_action('hgb_fraud_score')} AS recommended_action")


@query("f_tier_sort")
def _(spark, folder):
    return fr.tiered(spark, folder).selectExpr(
        "transaction_id", "risk_tier", f"{ex.tier_sort('risk_tier')} AS risk_tier_sort"
    )


@query("p_investigator")
def _(spark, folder):
    return output(tiers.investigator_queue(tiers.evaluation_queue(fr.tiered(spark, folder))))


# ---- filters ---------------------------------------------------------------
@query("flt_high_risk")
def _(spark, folder):
    return output(flt.high_risk(fr.transactions(spark, folder)).select("transaction_id", "type", "amount"))


@query("flt_null_safe_masks")
def _(spark, folder):
    return fr.defective(spark, folder).selectExpr(
        f"{ex.count_if(flt.FRAUD)} AS fraud_rows",
        f"{ex.count_if(f'NOT {flt.FRAUD}')} AS other_rows",
        f"{ex.count_if(flt.FLAGGED)} AS flagged_rows",
        f"{ex.count_if(f'NOT {flt.FLAGGED}')} AS unflagged_rows",
    )


@query("flt_blank_id")
def _(spark, folder):
    return fr.defective(spark, folder).selectExpr(
        f"{ex.count_if(flt.blank_identifier('nameOrig'))} AS blank_origin",
        f"{ex.count_if(flt.blank_identifier('nameDest'))} AS blank_destination",
    )


@query("flt_domain")
def _(spark, folder):
    return fr.defective(spark, folder).selectExpr(
        f"{ex.count_if(flt.INVALID_STEP)} AS invalid_step",
        f"{ex.count_if(flt.INVALID_TYPE)} AS invalid_type",
        f"{ex.count_if(flt.invalid_label('isFraud'))} AS invalid_isfraud",
        f"{ex.count_if(flt.invalid_label('isFlaggedFraud'))} AS invalid_isflagged",
    )


@query("flt_non_finite")
def _(spark, folder):
    bad = fr.defective(spark, folder).where(ex.non_finite("amount"))
    return bad.groupBy("nameDest").agg(F.expr("COUNT(*) AS non_finite_rows"))


@query("flt_split")
def _(spark, folder):
    model = fr.population(spark, folder)
    cut = sp.find_boundaries(model)
    return sp.with_split(model.select("transaction_id", "step"), cut)


@query("flt_scoring_period")
def _(spark, folder):
    cut = fr.bounds(spark, folder)
    period = flt.scoring_period(fr.master(spark, folder), cut.train_end, cut.validation_end)
    return output(period.select("transaction_id", "step", "type", "amount"))


@query("flt_alerts")
def _(spark, folder):
    return output(flt.alerts(fr.tiered(spark, folder)).select("transaction_id", "hgb_fraud_score"))


@query("flt_model_row")
def _(spark, folder):
    table = fr.comparison(spark, folder)
    by_part = flt.model_row(table, contains="HistGradientBoosting")
    by_name = flt.model_row(table, equals=S.RULE_MODEL)
    return output(by_part.unionByName(by_name).select("Model", "Threshold", "True_Positive", "Alerts"))


@query("flt_lift_not_null")
def _(spark, folder):
    lift = explore.flag_lift(fr.master(spark, folder))
    return output(explore.defined_lift(lift).select("Risk_Flag", "Fraud_Rate_Lift"))


# ---- joins -----------------------------------------------------------------
@query("j_partial_merge")
def _(spark, folder):
    rows = fr.transactions(spark, folder)
    parts = [rows.where(flt.HIGH_RISK), rows.where(f"NOT {flt.HIGH_RISK}")]
    return output(profile.partial_type_counts(parts))


@query("j_type_align")
def _(spark, folder):
    aligned = profile.type_profile(fr.transactions(spark, folder))
    return output(aligned.select("Transaction_Type", "Transaction_Count", "Transaction_Value", "Fraud_Count", "Fraud_Value"))


@query("j_prefix_outer")
def _(spark, folder):
    return quality.prefix_summary(fr.transactions(spark, folder))


@query("j_type_left")
def _(spark, folder):
    return quality.high_value_by_type(fr.transactions(spark, folder))


@query("j_band_dense")
def _(spark, folder):
    bands = explore.amount_band_summary(fr.master(spark, folder))
    return output(bands.select("Amount_Bucket", "Transaction_Count", "Fraud_Count"))


@query("j_tier_dense")
def _(spark, folder):
    dense = tiers.tier_summary(fr.tiered(spark, folder))
    return output(dense.select("Risk_Tier", "Transaction_Count", "Average_Model_Score", "Fraud_Rate_Pct"))


@query("j_threshold_broadcast")
def _(spark, folder):
    return output(fr.tiered(spark, folder).select("transaction_id", "hgb_fraud_score", "risk_tier", "operational_alert"))


@query("j_delta_baseline")
def _(spark, folder):
    return output(compare.delta_vs_baseline(fr.stress_comparison(spark, folder)))


@query("j_delta_pair")
def _(spark, folder):
    return output(compare.delta_pair(fr.comparison(spark, folder), fr.CHAMPION_NAME, fr.CHALLENGER_NAME))


# ---- profiling -------------------------------------------------------------
@query("q_sample_profile")
def _(spark, folder):
    sample = fr.transactions(spark, folder).where("transaction_id <= 100000")
    return profile.sample_profile(sample.select(*S.SOURCE_COLUMNS))


@query("q_overall_profile")
def _(spark, folder):
    return output(profile.overall_profile(fr.transactions(spark, folder)))


@query("q_missing")
def _(spark, folder):
    return output(profile.missing_values(fr.defective(spark, folder)))


@query("q_numeric_summary")
def _(spark, folder):
    return output(profile.numeric_summary(mapped.source_columns(spark, folder)))


@query("q_type_profile")
def _(spark, folder):
    return output(profile.type_profile(fr.transactions(spark, folder)))


@query("q_rule_performance")
def _(spark, folder):
    return output(profile.rule_performance(fr.transactions(spark, folder)))


@query("q_distinct_accounts")
def _(spark, folder):
    return profile.distinct_accounts(fr.transactions(spark, folder))


@query("q_duplicate_rows")
def _(spark, folder):
    return profile.duplicate_rows(fr.defective(spark, folder))


# ---- quality ---------------------------------------------------------------
@query("q_dq_audit")
def _(spark, folder):
    return quality.quality_audit(fr.defective(spark, folder))


@query("q_dq_zero_amount")
def _(spark, folder):
    return quality.zero_amounts(fr.defective(spark, folder))


@query("q_dq_non_finite")
def _(spark, folder):
    return quality.non_finite_count(fr.defective(spark, folder))


@query("q_balance_summary")
def _(spark, folder):
    return output(quality.balance_summary(fr.transactions(spark, folder)))


@query("q_prefix_summary")
def _(spark, folder):
    return quality.prefix_summary(fr.defective(spark, folder))


@query("q_high_value_profile")
def _(spark, folder):
    return quality.high_value_profile(fr.transactions(spark, folder))


@query("q_balance_consistency")
def _(spark, folder):
    return quality.balance_consistency(fr.transactions(spark, folder))


# ---- exploration -----------------------------------------------------------
@query("q_dataset_validation")
def _(spark, folder):
    """Without the two file sizes, which are those of this engine's files."""
    master, counted = writers.write_observed(fr.master(spark, folder), scratch_path(spark, "master"), explore.MASTER_MEASURES)
    model, modelled = writers.write_observed(model_population(master), scratch_path(spark, "model_population"), explore.MODEL_MEASURES)
    source = fr.transactions(spark, folder).selectExpr(*[f"{e} AS {n}" for n, e in explore.SOURCE_MEASURES.items()]).first().asDict()
    return output(explore.dataset_validation(source | counted | modelled, master, model).where("NOT contains(Metric, 'file size')"))


def _over_master(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    @query(name)
    def _(spark, folder):
        return output(operator(fr.master(spark, folder)))


def _over_population(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    @query(name)
    def _(spark, folder):
        return output(operator(fr.population(spark, folder)))


_over_master("q_class_summary", explore.class_summary)
_over_master("q_type_summary", explore.type_summary)
_over_master("q_hourly", explore.hourly_summary)
_over_master("q_daily", explore.daily_summary)
_over_master("q_amount_band", explore.amount_band_summary)
_over_master("q_flag_lift", explore.flag_lift)
_over_population("q_population_summary", explore.population_summary)
_over_population("q_feature_missing", explore.feature_missing)
_over_population("q_feature_infinite", explore.feature_infinite)
_over_population("q_high_risk_type", explore.high_risk_type_summary)
_over_population("q_binary_flag_lift", explore.binary_flag_lift)
_over_population("q_numeric_by_class", explore.numeric_by_class)
_over_population("q_fixed_split", explore.fixed_split_summary)
_over_population("q_feature_variation", explore.feature_variation)
_over_population("q_step_profile", lambda m: sp.step_profile(m).drop("total_rows"))
_over_population("q_split_boundaries", lambda m: sp.split_boundaries(sp.step_profile(m)))
_over_population("q_split_summary", lambda m: sp.split_summary(m, sp.find_boundaries(m)))


# ---- windows, sorts, limits ------------------------------------------------
_over_population("w_cumulative", lambda m: sp.step_profile(m).select("step", "cumulative_rows"))


@query("w_share_total")
def _(spark, folder):
    return output(views.risk_tier_analysis(fr.fact(spark, folder)).select("risk_tier", "population_pct"))


@query("w_capture")
def _(spark, folder):
    return output(views.transaction_type_risk(fr.fact(spark, folder)).select("transaction_type", "fraud_capture_pct"))


@query("w_value_capture")
def _(spark, folder):
    return output(views.risk_tier_analysis(fr.fact(spark, folder)).select("risk_tier", "fraud_value_capture_pct"))


@query("w_row_number")
def _(spark, folder):
    return views.feature_importance(fr.association(spark, folder)).select("feature", "importance_rank")


@query("w_investigation_rank")
def _(spark, folder):
    scored = mapped.with_scores(flt.high_risk(fr.master(spark, folder)), {tiers.SCORE: "champion"})
    rows = scored.select("transaction_id", tiers.SCORE, "amount")
    return output(ordering.global_row_number(rows, tiers.QUEUE_ORDER, "investigation_rank"))


@query("w_pr_cumulative")
def _(spark, folder):
    return output(fr.curve(spark, folder, "TEST").select("score", "n", "pos", "alerts", "tp", "place"))


@query("s_threshold_top50")
def _(spark, folder):
    return output(ev.top_thresholds(fr.curve(spark, folder, "VALIDATION")))


@query("s_argmax_f2")
def _(spark, folder):
    return output(ev.f2_threshold(fr.curve(spark, folder, "VALIDATION", S.CHALLENGER_MODEL)))


@query("s_queue")
def _(spark, folder):
    return output(
        tiers.sorted_alerts(fr.tiered(spark, folder)).select("transaction_id", "hgb_fraud_score", "amount")
    )


@query("s_top100")
def _(spark, folder):
    return output(tiers.top_alerts(fr.tiered(spark, folder)))


@query("s_sorts")
def _(spark, folder):
    types = compare.sort_types_by_rate(explore.type_summary(fr.master(spark, folder)))
    return output(types.select("Transaction_Type", "Fraud_Rate_Pct"))


@query("s_nulls_last")
def _(spark, folder):
    ordered = compare.sort_models_by_recall(fr.comparison(spark, folder))
    return output(ordered.select("Model", "Recall", "Precision"))


@query("s_case_order")
def _(spark, folder):
    ordered = contracts.tier_distribution(fr.fact(spark, folder))
    return ordered.select("risk_tier", "transaction_count")


@query("s_view_limit")
def _(spark, folder):
    queue = rt.queue_table(tiers.evaluation_queue(fr.tiered(spark, folder)))
    return output(views.first_in_queue(views.investigator_queue(queue)))


# ---- set operations and reshaping ------------------------------------------
@query("u_union_all")
def _(spark, folder):
    rows = fr.transactions(spark, folder)
    return contracts.row_counts(
        {
            "source": rows,
            "master": features.master_dataset(rows),
            "model_population": fr.population(spark, folder),
        }
    )


@query("u_concat")
def _(spark, folder):
    model = fr.population(spark, folder)
    cut = sp.find_boundaries(model)
    parts = [
        flt.in_split(model, name, *cut).select("transaction_id", "step", F.expr(f"'{name}' AS split"))
        for name in ("TRAIN", "VALIDATION", "TEST")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x_pivot")
def _(spark, folder):
    return output(compare.coefficient_pivot(fr.coefficient_table(spark, folder)))


@query("x_long")
def _(spark, folder):
    wide = fr.transactions(spark, folder).groupBy("type").agg(
        *[F.expr(f"{ex.double(f'SUM({c})')} AS {c}") for c in ("amount", "oldbalanceOrg", "oldbalanceDest")]
    )
    return output(wide.unpivot("type", ["amount", "oldbalanceOrg", "oldbalanceDest"], "Metric", "Value"))


# ---- evaluation ------------------------------------------------------------
@query("e_pr_curve")
def _(spark, folder):
    return output(ev.pr_curve(fr.curve(spark, folder, "VALIDATION")).select("Threshold", "Precision", "Recall"))


@query("e_f2_threshold")
def _(spark, folder):
    return output(ev.f2_threshold(fr.curve(spark, folder, "VALIDATION")))


@query("e_roc_curve")
def _(spark, folder):
    return output(ev.roc_curve(fr.curve(spark, folder, "TEST")))


@query("e_roc_auc")
def _(spark, folder):
    return output(ev.roc_auc(fr.curve(spark, folder, "TEST")))


@query("e_average_precision")
def _(spark, folder):
    return output(ev.average_precision(fr.curve(spark, folder, "TEST")))


@query("e_classification_metrics")
def _(spark, folder):
    return output(fr.ScoredRun(spark, folder).metrics("champion", fr.CHAMPION_NAME))


@query("e_rule_benchmark")
def _(spark, folder):
    period = flt.scoring_period(fr.master(spark, folder), fr.bounds(spark, folder).validation_end)
    return output(ev.rule_metrics(period))


@query("e_model_comparison")
def _(spark, folder):
    return output(fr.comparison(spark, folder))


@query("e_threshold_tradeoff")
def _(spark, folder):
    return output(ev.threshold_tradeoff(fr.curve(spark, folder, "VALIDATION")))


@query("e_quantile_tiers")
def _(spark, folder):
    return output(tiers.threshold_table(fr.ScoredRun(spark, folder).thresholds))


@query("e_tier_summary")
def _(spark, folder):
    return output(tiers.tier_summary(fr.tiered(spark, folder)))


@query("e_alert_summary")
def _(spark, folder):
    return output(tiers.alert_summary(fr.tiered(spark, folder)))


@query("e_queue")
def _(spark, folder):
    return output(tiers.evaluation_queue(fr.tiered(spark, folder)))


@query("e_capacity")
def _(spark, folder):
    return output(tiers.capacity_summary(fr.tiered(spark, folder)))


@query("e_scored_output")
def _(spark, folder):
    return output(tiers.scored_output(fr.tiered(spark, folder)))


# ---- views and contracts ---------------------------------------------------
def _view(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    @query(name)
    def _(spark, folder):
        return output(build(fr.fact(spark, folder)))


_view("v_executive_kpis", views.executive_kpis)
_view("v_risk_tier", views.risk_tier_analysis)
_view("v_transaction_type", views.transaction_type_risk)
_view("v_daily", views.daily_fraud_trend)
_view("v_hourly", views.hourly_fraud_pattern)
_view("v_confusion", views.confusion_matrix)
_view("v_band_dashboard", views.band_dashboard)
_view("c_fact_reconcile", contracts.fact_reconciliation)
_view("c_tier_distribution", contracts.tier_distribution)


@query("v_model_performance")
def _(spark, folder):
    models = rt.small_table(fr.comparison(spark, folder), "model_comparison")
    return output(views.model_performance(models))


@query("v_capacity")
def _(spark, folder):
    table = rt.small_table(tiers.capacity_summary(fr.tiered(spark, folder)), "investigation_capacity_summary")
    return output(views.investigation_capacity(table))


@query("v_queue")
def _(spark, folder):
    queue = rt.queue_table(tiers.evaluation_queue(fr.tiered(spark, folder)))
    return output(views.investigator_queue(queue))


@query("v_importance")
def _(spark, folder):
    return output(views.feature_importance(fr.association(spark, folder)))


@query("c_row_counts")
def _(spark, folder):
    return contracts.row_counts(fr.report_frames(spark, folder))


@query("c_queue_check")
def _(spark, folder):
    return output(contracts.queue_check(rt.queue_table(tiers.evaluation_queue(fr.tiered(spark, folder)))))


@query("c_model_check")
def _(spark, folder):
    return output(contracts.model_check(rt.small_table(fr.comparison(spark, folder), "model_comparison")))


@query("c_importance_check")
def _(spark, folder):
    return output(contracts.importance_check(fr.association(spark, folder)))


@query("c_view_smoke")
def _(spark, folder):
    made = views.create_views(spark, fr.report_frames(spark, folder))
    return contracts.view_smoke(spark, made)


@query("c_split_contract")
def _(spark, folder):
    model = fr.population(spark, folder)
    cut = sp.find_boundaries(model)
    stage = scratch_path(spark, "stages")
    writers.write_stages({"split": sp.split_summary(model, cut)}, stage)
    recorded = writers.read_stage(spark, stage, "split")
    contract = contracts.split_contract(sp.split_summary(model, sp.recorded_boundaries(recorded)), recorded)
    contracts.require_split_contract(contract)
    return contract


@query("c_no_rows_lost")
def _(spark, folder):
    stored = writers.write_parquet(fr.master(spark, folder), scratch_path(spark, "master"))
    return contracts.rows_lost(fr.transactions(spark, folder), stored)


@query("dq_constraints")
def _(spark, folder):
    table = "fact_scored_transactions"
    return quality.constraint_violations(
        fr.fact(spark, folder), rt.key_column(table), rt.required_columns(table), rt.FACT_FLAGS,
        {"risk_tier": S.TIERS},
    )


@query("dq_tables")
def _(spark, folder):
    """Rules of fact and queue, each alone and over both."""
    rows = fr.tiered(spark, folder)
    fact = rt.fact_table(rows)
    queue = rt.queue_table(tiers.evaluation_queue(rows))
    return contracts.table_constraints({"fact_scored_transactions": fact, "investigator_alert_queue": queue})


@query("g_clean_rules")
def _(spark, folder):
    judged = quality.judge_rows(fr.defective(spark, folder))
    reason = "CASE WHEN size(reason) = 0 THEN 'valid' ELSE array_join(reason, '+') END AS reason"
    return judged.groupBy(F.expr(reason)).agg(F.expr("COUNT(*) AS row_count"))


@query("g_leak_guard")
def _(spark, folder):
    frames = {"master": fr.master(spark, folder), "model_population": fr.population(spark, folder)}
    return quality.leakage_report(frames)


# ---- scalar functions ------------------------------------------------------
def _scalar(name: str, **expressions: str) -> None:
    @query(name)
    def _(spark, folder):
        rows = fr.master(spark, folder)
        return output(rows.selectExpr("transaction_id", *[f"{e} AS `{n}`" for n, e in expressions.items()]))


_scalar("fn_log1p", log1p_balance=f"log1p({ex.double('oldbalanceOrg')})")
_scalar("fn_trig", sine="sin(hour_of_day * 2 * pi() / 24)", cosine="cos(hour_of_day * 2 * pi() / 24)")
_scalar("fn_exp_clip", odds=ex.odds_ratio(f"({ex.double('amount')} - {ex.double('oldbalanceOrg')}) / 100000"))
_scalar("fn_abs", gap=f"abs({ex.double('oldbalanceOrg')} - {ex.double('amount')})")
_scalar("fn_floor_mod", day="CAST(floor((step - 25) / 24) AS BIGINT)", hour="CAST(pmod(step - 25, 24) AS BIGINT)")
_scalar("fn_round", in_hundreds="round(amount / 100, 2)", whole="round(amount, 0)")
_scalar(
    "fn_cast",
    as_short="CAST(step AS SMALLINT)",
    as_byte="CAST(step % 100 AS TINYINT)",
    as_long="CAST(step AS BIGINT)",
    as_decimal=f"CAST({ex.double('oldbalanceOrg')} AS DECIMAL(24,2))",
)
_scalar(
    "fn_nullif",
    null_ratio=ex.ratio("amount", "oldbalanceOrg"),
    zero_ratio=ex.ratio_or_zero("amount", "oldbalanceOrg"),
)
_scalar("fn_case", size="CASE WHEN amount > 400000 THEN 'large' WHEN amount > 100000 THEN 'middle' ELSE 'small' END")
_scalar("fn_set", risky=f"CAST({flt.HIGH_RISK} AS INT)")
_scalar(
    "fn_compare",
    **{
        name: f"CAST(amount {sign} oldbalanceOrg AS INT)"
        for name, sign in [("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")]
    },
)
_scalar(
    "fn_string",
    first=ex.prefix("nameDest"),
    merchant="CAST(startswith(nameDest, 'M') AS INT)",
    cash="CAST(contains(type, 'CASH') AS INT)",
    lowered="lower(type)",
    replaced="replace(type, '_', ' ')",
    trimmed="trim(concat('  ', nameOrig, ' '))",
)


@query("fn_null_tests")
def _(spark, folder):
    return fr.defective(spark, folder).selectExpr(
        "COUNT_IF(isFraud IS NULL) AS null_labels",
        "COUNT_IF(isFraud IS NOT NULL) AS labels",
        "SUM(COALESCE(isFraud, 0)) AS filled_sum",
        "COUNT(step) AS steps",
    )


@query("fn_nan_inf")
def _(spark, folder):
    return output(
        fr.defective(spark, folder).selectExpr(
            "COUNT_IF(isnan(amount)) AS nan_cells",
            f"COUNT_IF({ex.infinite('amount')}) AS infinite_cells",
            f"COUNT_IF(NOT {ex.non_finite('amount')}) AS finite_cells",
            f"SUM(nanvl(CASE WHEN {ex.infinite('amount')} THEN 0D ELSE amount - amount + 1 END, 0D)) AS finite_sum",
        )
    )


@query("fn_hash")
def _(spark, folder):
    """Distinct rows: hashes first, then the columns themselves, so equal hashes of different rows stay apart."""
    rows = fr.defective(spark, folder)
    hashed = rows.selectExpr("*", f"{profile.row_hash(rows.columns)} AS h").groupBy("h", *rows.columns).count()
    return hashed.selectExpr("COUNT(*) AS distinct_rows", "SUM(count) AS row_count")


@query("fn_aggs")
def _(spark, folder):
    measures = [
        "COUNT(*) AS rows",
        f"{ex.double('SUM(amount)')} AS total",
        f"{ex.ratio('SUM(amount)', 'COUNT(amount)')} AS mean",
        "MIN(amount) AS low",
        "MAX(amount) AS high",
        "COUNT(DISTINCT nameOrig) AS accounts",
        "min_by(nameOrig, transaction_id) AS first_account",
    ]
    grouped = fr.transactions(spark, folder).groupBy("type").agg(*[F.expr(m) for m in measures])
    return output(grouped)


@query("fn_text_format")
def _(spark, folder):
    counted = fr.transactions(spark, folder).groupBy("type").count()
    return counted.selectExpr("type", "concat(type, ': ', format_number(count, 0)) AS text")
