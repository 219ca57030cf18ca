"""Risk tiers, operational alerts, the investigation queue and its capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import (
    count_if, double, flag, is_one, percent_or_zero, ratio, ratio_or_zero, risk_tier, stack, sum_if,
    text, to_long, total,
)
from tallywatch.operators.evaluate import curve_quantiles
from tallywatch.operators.explore import dense
from tallywatch.operators.filters import FRAUD, alerts
from tallywatch.operators.ordering import bounded_rank, global_row_number, running_totals, sort_keys

SCORE = "hgb_fraud_score"
#: Score, then amount, highest first; equal keys keep file order.
QUEUE_ORDER = [f"{SCORE} DESC", "amount DESC", "transaction_id"]
QUEUE_COLUMNS = [
    "investigation_rank", "transaction_id", "step", "transaction_day", "hour_of_day", "type",
    "amount", "nameOrig", "nameDest", "oldbalanceOrg", "oldbalanceDest", SCORE, "risk_tier",
    "priority_band", "high_value_200k_flag", "isFlaggedFraud",
]
SCORED_COLUMNS = [
    "transaction_id", "step", "transaction_day", "hour_of_day", "type", "amount", "nameOrig",
    "nameDest", "oldbalanceOrg", "oldbalanceDest", "high_value_200k_flag", SCORE, "risk_tier",
    "operational_alert", "isFlaggedFraud", "isFraud",
]


# ---- thresholds ------------------------------------------------------------
def threshold_row(validation_curve: DataFrame, operating: float | Column) -> DataFrame:
    """One row: Critical, High, Medium and Operating thresholds."""
    operating = operating if isinstance(operating, Column) else F.lit(float(operating))
    return curve_quantiles(validation_curve, S.TIER_QUANTILES).withColumn("Operating", operating)


def fix_thresholds(row: DataFrame) -> DataFrame:
    """The same one row with its four numbers read once, as literals.

    Everything after it then compares with constants instead of evaluating the
    curve again for every table that needs a tier.
    """
    values = row.select("Critical", "High", "Medium", "Operating").first().asDict()
    return row.sparkSession.range(1).selectExpr(
        *[f"{'NULL' if v is None else f'{float(v)!r}D'} AS {name}" for name, v in values.items()]
    )


def threshold_table(row: DataFrame) -> DataFrame:
    # Names and sources of the four thresholds.
    names = [
        ("Medium Risk Threshold", "Validation 95th percentile", "Medium"),
        ("High Risk Threshold", "Validation 99th percentile", "High"),
        ("Critical Risk Threshold", "Validation 99.5th percentile", "Critical"),
        ("Operational Investigation Threshold", "Step 10 Validation F2 optimisation", "Operating"),
    ]
    rows = [[text(kind), text(source), double(c)] for kind, source, c in names]
    return row.selectExpr(stack(rows, ["Threshold_Type", "Source", "Score_Threshold"]))


def with_tiers(scored: DataFrame, thresholds: DataFrame, score: str = SCORE) -> DataFrame:
    """Tier and alert of every row from a one-row threshold frame.

    The row comes in as a scalar subquery: evaluated once, no join.
    """
    return scored.withColumn("cut", thresholds.selectExpr("struct(*)").scalar()).selectExpr(
        *scored.columns,
        f"{risk_tier(score, 'cut.Critical', 'cut.High', 'cut.Medium')} AS risk_tier",
        f"{flag(f'{score} >= cut.Operating')} AS operational_alert",
    )


# ---- summaries -------------------------------------------------------------
def tier_summary(scored: DataFrame, score: str = SCORE) -> DataFrame:
    """All four tiers in order: share, rate, capture and value capture."""
    observed = scored.groupBy("risk_tier").agg(
        F.expr("COUNT(*) AS n"),
        F.expr(f"SUM({double(score)}) AS score_sum"),
        F.expr(f"{total('amount')} AS value"),
        F.expr(f"{count_if(FRAUD)} AS fraud"),
        F.expr(f"{sum_if(FRAUD, 'amount')} AS fraud_value"),
        F.expr(f"{count_if('operational_alert = 1')} AS alerts"),
    )
    whole = lambda c: f"SUM({c}) OVER ()"  # over the four tier rows
    return dense(observed, S.TIERS, "risk_tier").selectExpr(
        "risk_tier AS Risk_Tier",
        "COALESCE(n, 0) AS Transaction_Count",
        f"{percent_or_zero('n', whole('n'))} AS Population_Pct",
        f"{ratio('score_sum', 'n')} AS Average_Model_Score",
        f"COALESCE({double('value')}, 0D) AS Transaction_Value",
        "COALESCE(fraud, 0) AS Fraud_Count",
        f"{percent_or_zero('fraud', 'n')} AS Fraud_Rate_Pct",
        f"{percent_or_zero('fraud', whole('fraud'))} AS Fraud_Capture_Pct",
        f"COALESCE({double('fraud_value')}, 0D) AS Fraud_Value",
        f"{percent_or_zero('fraud_value', whole('fraud_value'))} AS Fraud_Value_Capture_Pct",
        "COALESCE(alerts, 0) AS Operational_Alerts",
    )


def alert_summary(scored: DataFrame) -> DataFrame:
    """Nineteen measures: the champion against the existing rule."""
    cells = []
    for side, column in (("m", "operational_alert"), ("r", "isFlaggedFraud")):
        hit = is_one(column)
        cells += [
            f"{count_if(f'{FRAUD} AND {hit}')} AS {side}_tp",
            f"{count_if(f'NOT {FRAUD} AND {hit}')} AS {side}_fp",
            f"{count_if(f'{FRAUD} AND NOT {hit}')} AS {side}_fn",
        ]
    row = scored.selectExpr("COUNT(*) AS rows", f"{count_if(FRAUD)} AS fraud", *cells)
    # Metric names of the alert summary.
    return to_long(
        row,
        [
            ("Test transactions", "rows"),
            ("Actual fraud transactions", "fraud"),
            ("Champion model alerts", "m_tp + m_fp"),
            ("Champion model alert rate (%)", percent_or_zero("m_tp + m_fp", "rows")),
            ("Champion model true positives", "m_tp"),
            ("Champion model false positives", "m_fp"),
            ("Champion model false negatives", "m_fn"),
            ("Champion model precision (%)", percent_or_zero("m_tp", "m_tp + m_fp")),
            ("Champion model recall (%)", percent_or_zero("m_tp", "m_tp + m_fn")),
            ("Champion model F1", ratio_or_zero("2 * m_tp", "2 * m_tp + m_fp + m_fn")),
            ("Champion model F2", ratio_or_zero("5 * m_tp", "5 * m_tp + 4 * m_fn + m_fp")),
            ("Legacy rule alerts", "r_tp + r_fp"),
            ("Legacy rule true positives", "r_tp"),
            ("Legacy rule false positives", "r_fp"),
            ("Legacy rule false negatives", "r_fn"),
            ("Legacy rule precision (%)", percent_or_zero("r_tp", "r_tp + r_fp")),
            ("Legacy rule recall (%)", percent_or_zero("r_tp", "r_tp + r_fn")),
            ("Additional fraud detected vs legacy rule", "m_tp - r_tp"),
            ("Detection multiple vs legacy rule", ratio("m_tp", "r_tp")),
        ],
        "Metric",
        "Value",
    )


# ---- queue -----------------------------------------------------------------
def sorted_alerts(scored: DataFrame) -> DataFrame:
    return alerts(scored).orderBy(*sort_keys(QUEUE_ORDER))


def evaluation_queue(scored: DataFrame, partitions: int | None = None) -> DataFrame:
    """All alerts with rank 1..n, band and label, for evaluation.

    The rank is global but needs no single task (see ``ordering``).
    """
    rows = alerts(scored).selectExpr("*", "risk_tier AS priority_band")
    ranked = global_row_number(rows, QUEUE_ORDER, "investigation_rank", partitions)
    return ranked.select(*QUEUE_COLUMNS, "isFraud")


def investigator_queue(evaluation: DataFrame) -> DataFrame:
    """The queue without the label."""
    return evaluation.select(*QUEUE_COLUMNS)


def top_alerts(scored: DataFrame, count: int = 100) -> DataFrame:
    """The first alerts of the queue; needs no global rank."""
    rows = alerts(scored).selectExpr("*", "risk_tier AS priority_band")
    return bounded_rank(rows, QUEUE_ORDER, count, "investigation_rank").select(*QUEUE_COLUMNS)


def capacity_summary(scored: DataFrame, levels: list[int] = S.CAPACITY_LEVELS) -> DataFrame:
    """Fraud found when only the first L alerts are reviewed, and at all alerts.

    Alerts are counted per score, and the running counts tell the score that
    each level falls in. Whole scores above it count as they are; only alerts of
    the scores that a level cuts are ranked, in several tasks. At most one score
    per level is cut, and its ties are broken by amount and id.
    """
    first = alerts(scored).selectExpr(f"{double(SCORE)} AS {SCORE}", "amount", "transaction_id", "isFraud")
    groups = first.groupBy(SCORE).agg(F.expr("COUNT(*) AS n"), F.expr(f"{count_if(FRAUD)} AS pos"))
    curve = running_totals(groups, [f"{SCORE} DESC"], {"reviewed": "n", "found": "pos"})
    listed = ", ".join(f"{level}L" for level in levels)
    cuts = curve.selectExpr("*", f"explode(array({listed})) AS level").where("reviewed - n < level AND level < reviewed")
    cut_rows = first.join(F.broadcast(cuts.selectExpr(SCORE).distinct()), SCORE)  # one row per level at most
    ranked = global_row_number(cut_rows, QUEUE_ORDER, "place")
    inside = ranked.join(F.broadcast(ranked.groupBy(SCORE).agg(F.expr("MIN(place) AS first_place"))), SCORE)
    partial = (
        inside.join(F.broadcast(cuts.selectExpr(SCORE, "level", "reviewed - n AS above")), SCORE)
        .where("above + place - first_place < level")
        .groupBy("level")
        .agg(F.expr("COUNT(*) AS n"), F.expr(f"{count_if(FRAUD)} AS f"))
    )
    whole_scores = curve.selectExpr(
        f"inline(array({', '.join(f'struct({level}L AS level, IF(reviewed <= {level}, n, 0L) AS n, IF(reviewed <= {level}, pos, 0L) AS f)' for level in levels)}))"
    ).groupBy("level").agg(F.expr("SUM(n) AS n"), F.expr("SUM(f) AS f"))
    counted = whole_scores.unionByName(partial).groupBy("level").agg(F.expr("SUM(n) AS n"), F.expr("SUM(f) AS f"))
    whole = scored.selectExpr(
        f"struct({count_if('operational_alert = 1')} AS alerts, "
        f"{count_if(f'operational_alert = 1 AND {FRAUD}')} AS found, {count_if(FRAUD)} AS fraud)"
    ).scalar()
    every = scored.sparkSession.range(1).selectExpr(f"inline(array({', '.join(f'struct({level}L AS level)' for level in levels)}))")
    rows = every.join(counted, "level", "left").withColumn("whole", whole).selectExpr(
        "whole.fraud AS fraud", "level AS Investigation_Capacity", "COALESCE(n, 0) AS Alerts_Reviewed", "COALESCE(f, 0) AS Fraud_Found"
    )
    everything = scored.sparkSession.range(1).withColumn("whole", whole).selectExpr(
        "whole.fraud AS fraud", "whole.alerts AS Investigation_Capacity", "whole.alerts AS Alerts_Reviewed", "whole.found AS Fraud_Found"
    )
    return (
        rows.unionByName(everything)
        .distinct()
        .selectExpr(
            "Investigation_Capacity",
            "Alerts_Reviewed",
            "Fraud_Found",
            f"{percent_or_zero('Fraud_Found', 'Alerts_Reviewed')} AS Precision_Pct",
            f"{percent_or_zero('Fraud_Found', 'fraud')} AS Total_Test_Fraud_Captured_Pct",
        )
        .orderBy("Investigation_Capacity")
    )


def scored_output(scored: DataFrame) -> DataFrame:
    """The 16 columns of the scored population."""
    return scored.select(*SCORED_COLUMNS)
