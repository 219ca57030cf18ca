"""Checks after a load: row counts, reconciliation, distribution, split counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.exprs import count_if, rounded, rounded_percent, text, tier_sort
from tallywatch.operators.quality import constraint_violations
from tallywatch.report import tables as rt


class ContractError(AssertionError):
    """A stored count and the data disagree."""


def row_counts(tables: dict[str, DataFrame], name: str = "table_name") -> DataFrame:
    """Rows of every table, by name."""
    counts = None
    for table in sorted(tables):
        part = tables[table].selectExpr("COUNT(*) AS row_count").selectExpr(f"{text(table)} AS {name}", "row_count")
        counts = part if counts is None else counts.unionByName(part)
    return counts


def fact_reconciliation(fact: DataFrame) -> DataFrame:
    return fact.selectExpr(
        "COUNT(*) AS transactions",
        "SUM(actual_fraud) AS actual_fraud",
        "SUM(operational_alert) AS operational_alerts",
        f"{count_if('actual_fraud = 1 AND operational_alert = 1')} AS true_positives",
        f"{count_if('actual_fraud = 0 AND operational_alert = 1')} AS false_positives",
        f"{count_if('actual_fraud = 1 AND operational_alert = 0')} AS false_negatives",
    )


def tier_distribution(fact: DataFrame) -> DataFrame:
    """Counts per tier, most severe first."""
    grouped = fact.groupBy("risk_tier").agg(
        F.expr("COUNT(*) AS transaction_count"),
        F.expr("SUM(actual_fraud) AS fraud_count"),
        F.expr("SUM(operational_alert) AS operational_alerts"),
    )
    rate = rounded_percent("fraud_count", "transaction_count", 4)
    return grouped.selectExpr("*", f"{rate} AS fraud_rate_pct").orderBy(F.expr(tier_sort("risk_tier")))


def queue_check(queue: DataFrame) -> DataFrame:
    return queue.selectExpr(
        "COUNT(*) AS alert_queue_rows",
        "MIN(investigation_rank) AS first_rank",
        "MAX(investigation_rank) AS last_rank",
        "MIN(hgb_fraud_score) AS minimum_alert_score",
        "MAX(hgb_fraud_score) AS maximum_alert_score",
    )


def table_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, constraint_name, violations): all rules of the given tables in one plan.

    Keys are unique, required columns filled, flags 0 or 1, listed values from
    their lists. Over tables: every row of the queue is an alert of the fact and
    agrees with its score and tier, every alert is in the queue, ranks run from 1
    without gaps in the order of scores, and the tier summary counts the fact's rows.
    """
    parts = []
    for name, df in tables.items():
        found = constraint_violations(
            df, rt.key_column(name), rt.required_columns(name), rt.TABLE_FLAGS.get(name, []), rt.TABLE_DOMAINS.get(name, {})
        )
        parts.append(found.selectExpr(f"{text(name)} AS table_name", "constraint_name", "violations"))
    fact, queue, summary = (tables.get(n) for n in ("fact_scored_transactions", "investigator_alert_queue", "risk_tier_summary"))
    rule = lambda df, table, name, test: df.selectExpr(
        f"{text(table)} AS table_name", f"{text(name)} AS constraint_name", f"{count_if(test)} AS violations"
    )
    if fact is not None and queue is not None:
        alerts = fact.where("operational_alert = 1").select("transaction_id", "hgb_fraud_score", "risk_tier")
        pairs = queue.select("transaction_id", "hgb_fraud_score", "risk_tier", "investigation_rank").alias("q").join(
            alerts.alias("a"), "transaction_id", "full_outer"
        )
        parts.append(rule(pairs, "investigator_alert_queue", "in_fact:transaction_id", "a.risk_tier IS NULL AND a.hgb_fraud_score IS NULL"))
        parts.append(rule(pairs, "investigator_alert_queue", "agrees:score_and_tier",
                          "investigation_rank IS NOT NULL AND a.risk_tier IS NOT NULL AND (q.hgb_fraud_score <> a.hgb_fraud_score OR q.risk_tier <> a.risk_tier)"))
        parts.append(rule(pairs, "fact_scored_transactions", "in_queue:alerts", "investigation_rank IS NULL"))
    if queue is not None:
        span = queue.selectExpr("COUNT(*) AS n", "MIN(investigation_rank) AS low", "MAX(investigation_rank) AS high")
        parts.append(rule(span, "investigator_alert_queue", "gapless:investigation_rank", "n > 0 AND (low <> 1 OR high <> n)"))
    if fact is not None and summary is not None:
        counted = fact.groupBy("risk_tier").agg(F.expr("COUNT(*) AS n"))
        both = summary.select("risk_tier", "transaction_count").join(counted, "risk_tier", "full_outer")
        parts.append(rule(both, "risk_tier_summary", "counts:transaction_count", "COALESCE(n, 0) <> COALESCE(transaction_count, 0)"))
    return reduce(DataFrame.unionByName, parts)


def require_constraints(tables: dict[str, DataFrame]) -> None:
    """Raise ``ContractError`` when any rule of the tables is broken."""
    bad = table_constraints(tables).where("violations > 0").take(10)
    if bad:
        raise ContractError("; ".join(f"{r['table_name']}, {r['constraint_name']}: {r['violations']}" for r in bad))


def load_report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The checks that are kept with every load."""
    fact, queue = tables["fact_scored_transactions"], tables["investigator_alert_queue"]
    return {
        "row_counts": row_counts(tables),
        "fact_reconciliation": fact_reconciliation(fact),
        "tier_distribution": tier_distribution(fact),
        "queue_check": queue_check(queue),
        "constraints": table_constraints(tables),
    }


def model_check(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc_nulls_last("recall"), F.asc("model")).selectExpr(
        "model",
        f"{rounded('precision * 100D', 2)} AS precision_pct",
        f"{rounded('recall * 100D', 2)} AS recall_pct",
        f"{rounded('f2', 4)} AS f2",
        "true_positive",
        "false_positive",
        "false_negative",
        "alerts",
    )


def importance_check(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), F.asc("feature")).selectExpr(
        "feature", f"{rounded('importance_mean', 4)} AS importance_mean"
    )


def view_smoke(spark: SparkSession, views: list[str]) -> DataFrame:
    """Row count of every view, and whether its rows could be computed in all columns (0 for an empty view).

    A bare count would let the optimiser drop all columns, and a failing
    expression would pass.
    """
    parts = None
    for view in views:
        frame = spark.table(view)
        part = frame.selectExpr(f"xxhash64({', '.join(f'`{c}`' for c in frame.columns)}) AS mark").selectExpr(
            f"{text(view)} AS view_name", "COUNT(*) AS row_count", "CAST(max(mark) IS NOT NULL AS INT) AS computed"
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


# ---- split and stage contracts ---------------------------------------------
def split_contract(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded and actual rows per split, with a match flag."""
    return (
        recorded.selectExpr("Split", "Rows AS recorded")
        .join(actual.selectExpr("Split", "Rows AS actual"), "Split", "full_outer")
        .selectExpr(
            "Split",
            "COALESCE(recorded, 0) AS recorded_rows",
            "COALESCE(actual, 0) AS actual_rows",
            "CAST(COALESCE(recorded, 0) = COALESCE(actual, 0) AS INT) AS matches",
        )
    )


def require_split_contract(contract: DataFrame) -> None:
    """Raise when a split's rows differ from the record."""
    bad = contract.where("matches = 0").take(3)
    if bad:
        raise ContractError(
            "; ".join(f"{r['Split']}: {r['actual_rows']} rows, {r['recorded_rows']} recorded" for r in bad)
        )


def rows_lost(source: DataFrame, master: DataFrame) -> DataFrame:
    kept = master.selectExpr("COUNT(*)").scalar()
    counted = source.selectExpr("COUNT(*) AS source_rows").withColumn("master_rows", kept)
    return counted.selectExpr("*", "source_rows - master_rows AS rows_lost")
