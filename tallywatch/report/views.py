"""The ten reporting views, and the band figure of the dashboard.

Each is one aggregate over the scored fact (or a projection of a small table).
Shares of a total use a window over the few grouped rows, so the fact is read
once. Money is summed as decimals and rounded half away from zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.exprs import (
    amount_band, count_if, double, recommended_action, rounded, rounded_percent, stack, sum_if,
    text, tier_sort,
)

_FRAUD, _ALERT = "actual_fraud = 1", "operational_alert = 1"
_OUTCOMES = {
    "true_positives": f"{_FRAUD} AND {_ALERT}",
    "false_positives": f"actual_fraud = 0 AND {_ALERT}",
    "false_negatives": f"{_FRAUD} AND operational_alert = 0",
    "true_negatives": "actual_fraud = 0 AND operational_alert = 0",
}
_AMOUNT = "CAST(amount AS DECIMAL(20,2))"


def _whole(column: str) -> str:
    """Total over the grouped rows, a handful by then."""
    return f"SUM({column}) OVER ()"


def _money(column: str, name: str) -> str:
    return f"{double(f'round({column}, 2)')} AS {name}"


def _share(a: str, b: str, name: str, places: int = 4) -> str:
    return f"{rounded_percent(a, b, places)} AS {name}"


def executive_kpis(fact: DataFrame) -> DataFrame:
    row = fact.selectExpr(
        "COUNT(*) AS rows",
        f"SUM({_AMOUNT}) AS value",
        "SUM(actual_fraud) AS fraud",
        f"{sum_if(_FRAUD, _AMOUNT)} AS fraud_value",
        "SUM(operational_alert) AS alerts",
        *[f"{count_if(test)} AS {name}" for name, test in _OUTCOMES.items()],
        "SUM(legacy_rule_flag) AS legacy",
        f"{count_if(f'legacy_rule_flag = 1 AND {_FRAUD}')} AS legacy_hits",
    )
    return row.selectExpr(
        "rows AS total_transactions",
        _money("value", "total_transaction_value"),
        "fraud AS fraud_transactions",
        _money("fraud_value", "fraud_transaction_value"),
        _share("fraud", "rows", "fraud_rate_pct"),
        "alerts AS operational_alerts",
        _share("alerts", "rows", "alert_rate_pct"),
        "true_positives",
        "false_positives",
        "false_negatives",
        _share("true_positives", "alerts", "model_precision_pct", 2),
        _share("true_positives", "fraud", "model_recall_pct", 2),
        "legacy AS legacy_rule_alerts",
        "legacy_hits AS legacy_rule_true_positives",
    )


def _grouped(fact: DataFrame, key: str) -> DataFrame:
    """The measures every grouped view draws on."""
    measures = [
        "COUNT(*) AS transaction_count",
        f"SUM({_AMOUNT}) AS value",
        "SUM(actual_fraud) AS fraud_count",
        f"{sum_if(_FRAUD, _AMOUNT)} AS fraud_amount",
        "SUM(operational_alert) AS operational_alerts",
        "AVG(hgb_fraud_score) AS score",
    ]
    return fact.groupBy(key).agg(*[F.expr(m) for m in measures])


_VALUE = _money("value", "transaction_value")
_FRAUD_VALUE = _money("fraud_amount", "fraud_value")
_RATE = _share("fraud_count", "transaction_count", "fraud_rate_pct")
_CAPTURE = _share("fraud_count", _whole("fraud_count"), "fraud_capture_pct")
_SCORE = f"{rounded('score', 6)} AS average_model_score"


def risk_tier_analysis(fact: DataFrame) -> DataFrame:
    return _grouped(fact, "risk_tier").selectExpr(
        "risk_tier",
        f"{tier_sort('risk_tier')} AS risk_tier_sort",
        "transaction_count",
        _share("transaction_count", _whole("transaction_count"), "population_pct"),
        _SCORE,
        _VALUE,
        "fraud_count",
        _RATE,
        _CAPTURE,
        _FRAUD_VALUE,
        _share("fraud_amount", _whole("fraud_amount"), "fraud_value_capture_pct"),
        "operational_alerts",
    )


def transaction_type_risk(fact: DataFrame) -> DataFrame:
    average = "CAST(value AS DECIMAL(28,2)) / CAST(transaction_count AS DECIMAL(18,0))"
    return _grouped(fact, "transaction_type").selectExpr(
        "transaction_type",
        "transaction_count",
        _VALUE,
        _money(average, "average_transaction_amount"),
        "fraud_count",
        _FRAUD_VALUE,
        _RATE,
        _CAPTURE,
        "operational_alerts",
        _share("operational_alerts", "transaction_count", "alert_rate_pct"),
        _SCORE,
    )


def _over_time(fact: DataFrame, key: str) -> DataFrame:
    measures = [_VALUE, "fraud_count", _FRAUD_VALUE, _RATE, "operational_alerts", _SCORE]
    return _grouped(fact, key).selectExpr(key, "transaction_count", *measures).orderBy(key)


def daily_fraud_trend(fact: DataFrame) -> DataFrame:
    return _over_time(fact, "transaction_day")


def hourly_fraud_pattern(fact: DataFrame) -> DataFrame:
    return _over_time(fact, "hour_of_day")


def confusion_matrix(fact: DataFrame) -> DataFrame:
    """Four outcome rows from one scan."""
    row = fact.selectExpr(*[f"{count_if(test)} AS {name}" for name, test in _OUTCOMES.items()])
    # Outcomes in report order.
    names = ["True Positive", "False Positive", "False Negative", "True Negative"]
    rows = [[text(n), str(i), c] for i, (n, c) in enumerate(zip(names, _OUTCOMES), start=1)]
    return row.selectExpr(stack(rows, ["outcome", "outcome_sort", "transaction_count"]))


def model_performance(models: DataFrame) -> DataFrame:
    return models.selectExpr(
        "model",
        "threshold",
        *[f"{rounded(c, 4)} AS {c}" for c in ("roc_auc", "average_precision", "f1", "f2")],
        *[f"{rounded(f'{c} * 100D', 2)} AS {c}_pct" for c in ("accuracy", "precision", "recall")],
        "true_negative",
        "false_positive",
        "false_negative",
        "true_positive",
        "alerts",
        *[f"{rounded(c, 4)} AS {c}" for c in ("alert_rate_pct", "false_positive_rate_pct")],
    )


def investigation_capacity(capacity: DataFrame) -> DataFrame:
    return capacity.selectExpr(
        "investigation_capacity",
        "alerts_reviewed",
        "fraud_found",
        f"{rounded('precision_pct', 2)} AS precision_pct",
        f"{rounded('total_test_fraud_captured_pct', 2)} AS fraud_capture_pct",
    ).orderBy("investigation_capacity")


def investigator_queue(queue: DataFrame) -> DataFrame:
    """The queue with a rounded score and the recommended action.

    Not sorted here: the rank column carries the order, and a reader that needs
    rows in order sorts on it.
    """
    return queue.selectExpr(
        "investigation_rank", "transaction_id", "step", "transaction_day", "hour_of_day",
        "transaction_type", "amount", "origin_account", "destination_account",
        "oldbalance_org", "oldbalance_dest",
        f"{rounded('hgb_fraud_score', 6)} AS fraud_risk_score",
        "risk_tier", "priority_band", "high_value_200k_flag", "legacy_rule_flag",
        f"{recommended_action('hgb_fraud_score')} AS recommended_action",
    )


def first_in_queue(queue_view: DataFrame, count: int = 20) -> DataFrame:
    """The first rows of the queue view; the order is stated, not assumed."""
    return queue_view.orderBy("investigation_rank").limit(count)


def feature_importance(importance: DataFrame) -> DataFrame:
    return importance.selectExpr(
        "feature",
        f"{rounded('importance_mean', 4)} AS importance_mean",
        f"{rounded('importance_std', 4)} AS importance_std",
        "ROW_NUMBER() OVER (ORDER BY importance_mean DESC, feature) AS importance_rank",
    )


def band_dashboard(fact: DataFrame) -> DataFrame:
    """Fraud rate per amount band of the scored test population."""
    grouped = fact.groupBy(F.expr(f"{amount_band('amount')} AS amount_band")).agg(
        F.expr("COUNT(*) AS transaction_count"), F.expr("SUM(actual_fraud) AS fraud_count")
    )
    return grouped.selectExpr("*", _share("fraud_count", "transaction_count", "fraud_rate_pct", 2))


# View name to the table it reads; the builder is ours.
VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "vw_executive_fraud_kpis": ("fact_scored_transactions", executive_kpis),
    "vw_risk_tier_analysis": ("fact_scored_transactions", risk_tier_analysis),
    "vw_transaction_type_risk": ("fact_scored_transactions", transaction_type_risk),
    "vw_daily_fraud_trend": ("fact_scored_transactions", daily_fraud_trend),
    "vw_hourly_fraud_pattern": ("fact_scored_transactions", hourly_fraud_pattern),
    "vw_confusion_matrix": ("fact_scored_transactions", confusion_matrix),
    "vw_model_performance": ("model_comparison", model_performance),
    "vw_investigation_capacity": ("investigation_capacity_summary", investigation_capacity),
    "vw_investigator_queue": ("investigator_alert_queue", investigator_queue),
    "vw_feature_importance": ("hgb_feature_importance", feature_importance),
}


def create_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Register every view whose table is given; returns their names."""
    made = []
    for view, (table, build) in VIEWS.items():
        if table in tables:
            build(tables[table]).createOrReplaceTempView(view)
            made.append(view)
    return made
