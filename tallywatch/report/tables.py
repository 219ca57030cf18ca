"""The eight reporting tables: declared schemas and the projections that fill them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, types as T

from tallywatch import schema as S

# ---- Fixed values: table definitions; the first column is the key ------------
TABLE_COLUMNS = {
    "fact_scored_transactions": """
        transaction_id BIGINT NOT NULL,
        step SMALLINT NOT NULL,
        transaction_day SMALLINT NOT NULL,
        hour_of_day SMALLINT NOT NULL,
        transaction_type STRING NOT NULL,
        amount DECIMAL(20,2) NOT NULL,
        origin_account STRING NOT NULL,
        destination_account STRING NOT NULL,
        oldbalance_org DECIMAL(20,2) NOT NULL,
        oldbalance_dest DECIMAL(20,2) NOT NULL,
        high_value_200k_flag SMALLINT NOT NULL,
        hgb_fraud_score DOUBLE NOT NULL,
        risk_tier STRING NOT NULL,
        operational_alert SMALLINT NOT NULL,
        legacy_rule_flag SMALLINT NOT NULL,
        actual_fraud SMALLINT NOT NULL
    """,
    "investigator_alert_queue": """
        investigation_rank BIGINT NOT NULL,
        transaction_id BIGINT NOT NULL,
        step SMALLINT NOT NULL,
        transaction_day SMALLINT NOT NULL,
        hour_of_day SMALLINT NOT NULL,
        transaction_type STRING NOT NULL,
        amount DECIMAL(20,2) NOT NULL,
        origin_account STRING NOT NULL,
        destination_account STRING NOT NULL,
        oldbalance_org DECIMAL(20,2) NOT NULL,
        oldbalance_dest DECIMAL(20,2) NOT NULL,
        hgb_fraud_score DOUBLE NOT NULL,
        risk_tier STRING NOT NULL,
        priority_band STRING NOT NULL,
        high_value_200k_flag SMALLINT NOT NULL,
        legacy_rule_flag SMALLINT NOT NULL
    """,
    "risk_tier_thresholds": """
        threshold_type STRING NOT NULL,
        source STRING,
        score_threshold DOUBLE NOT NULL
    """,
    "risk_tier_summary": """
        risk_tier STRING NOT NULL,
        transaction_count BIGINT NOT NULL,
        population_pct DOUBLE,
        average_model_score DOUBLE,
        transaction_value DECIMAL(24,2),
        fraud_count BIGINT,
        fraud_rate_pct DOUBLE,
        fraud_capture_pct DOUBLE,
        fraud_value DECIMAL(24,2),
        fraud_value_capture_pct DOUBLE,
        operational_alerts BIGINT
    """,
    "operational_alert_summary": """
        metric STRING NOT NULL,
        value DOUBLE
    """,
    "investigation_capacity_summary": """
        investigation_capacity BIGINT NOT NULL,
        alerts_reviewed BIGINT,
        fraud_found BIGINT,
        precision_pct DOUBLE,
        total_test_fraud_captured_pct DOUBLE
    """,
    "model_comparison": """
        model STRING NOT NULL,
        threshold DOUBLE,
        roc_auc DOUBLE,
        average_precision DOUBLE,
        accuracy DOUBLE,
        precision DOUBLE,
        recall DOUBLE,
        f1 DOUBLE,
        f2 DOUBLE,
        true_negative BIGINT,
        false_positive BIGINT,
        false_negative BIGINT,
        true_positive BIGINT,
        alerts BIGINT,
        alert_rate_pct DOUBLE,
        false_positive_rate_pct DOUBLE
    """,
    "hgb_feature_importance": """
        feature STRING NOT NULL,
        importance_mean DOUBLE,
        importance_std DOUBLE
    """,
}
FACT_FLAGS = ["high_value_200k_flag", "operational_alert", "legacy_rule_flag", "actual_fraud"]



class Layout(NamedTuple):
    """How a large table lies on disk: folders, order inside and between files, columns looked up by single values."""

    partition_by: list[str]
    order: list[str]
    lookups: list[str]


LAYOUTS = {
    "fact_scored_transactions": Layout(
        ["transaction_day"], ["transaction_type", "hgb_fraud_score"], ["transaction_id", "origin_account", "destination_account"]
    ),
    "investigator_alert_queue": Layout([], ["investigation_rank"], ["transaction_id"]),
}

# ---- Fixed values: value lists of the tables --------------------------------
TABLE_DOMAINS = {
    "fact_scored_transactions": {"risk_tier": S.TIERS, "transaction_type": S.ALLOWED_TYPES},
    "investigator_alert_queue": {"risk_tier": S.TIERS, "priority_band": S.TIERS, "transaction_type": S.ALLOWED_TYPES},
    "risk_tier_summary": {"risk_tier": S.TIERS},
}
TABLE_FLAGS = {"fact_scored_transactions": FACT_FLAGS, "investigator_alert_queue": ["high_value_200k_flag", "legacy_rule_flag"]}

# ---- Fixed values: names that differ between frames and tables --------------
TRANSACTION_NAMES = {
    "type": "transaction_type",
    "nameOrig": "origin_account",
    "nameDest": "destination_account",
    "oldbalanceOrg": "oldbalance_org",
    "oldbalanceDest": "oldbalance_dest",
    "isFlaggedFraud": "legacy_rule_flag",
    "isFraud": "actual_fraud",
}


def table_schema(table: str) -> T.StructType:
    """The declared schema; needs a running session to read the type names."""
    return T.StructType.fromDDL(TABLE_COLUMNS[table])


def column_names(table: str) -> list[str]:
    return table_schema(table).fieldNames()


def key_column(table: str) -> str:
    return column_names(table)[0]


def required_columns(table: str) -> list[str]:
    return [f.name for f in table_schema(table) if not f.nullable]


def create_schema(spark: SparkSession, database: str) -> None:
    """Create the database and its empty tables, dropping older ones."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table in TABLE_COLUMNS:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
        spark.sql(f"CREATE TABLE {database}.{table} ({TABLE_COLUMNS[table]}) USING parquet")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views by name; temporary views only without a database."""
    rows = [
        (t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "TABLE")
        for t in spark.catalog.listTables(database)
        if database is None or not t.isTemporary
    ]
    return spark.createDataFrame(sorted(rows), "table_name string, table_kind string")


def conform(df: DataFrame, table: str, names: dict[str, str] | None = None) -> DataFrame:
    """Rename, select and cast a frame to a table's columns."""
    source = {new: old for old, new in (names or {}).items()}
    return df.selectExpr(
        *[f"CAST(`{source.get(f.name, f.name)}` AS {f.dataType.simpleString()}) AS {f.name}" for f in table_schema(table)]
    )


def fact_table(scored: DataFrame) -> DataFrame:
    return conform(scored, "fact_scored_transactions", TRANSACTION_NAMES)


def queue_table(queue: DataFrame) -> DataFrame:
    return conform(queue, "investigator_alert_queue", TRANSACTION_NAMES)


def small_table(df: DataFrame, table: str) -> DataFrame:
    """A summary frame as its table; names differ only in case."""
    return conform(df, table, {c: c.lower() for c in df.columns})
