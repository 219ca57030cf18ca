"""Profiling summaries of the raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import (
    count_if, double, is_floating, missing, percent_or_zero, ratio, stack, sum_if, text, to_long,
    to_rows, total,
)
from tallywatch.operators.filters import FLAGGED, FRAUD
from tallywatch.operators.onepass import Summary, one_row
from tallywatch.session import materialise


# ---- distinct accounts and duplicates --------------------------------------
def distinct_accounts(df: DataFrame) -> DataFrame:
    """Exact distinct origin and destination accounts, one row.

    Two single-column group-bys rather than one aggregate with two DISTINCTs:
    that one would copy every row once per column before the shuffle. Repeated
    accounts are folded on the map side, so a hot account is one row per task.
    """
    origin = df.select("nameOrig").distinct().selectExpr("COUNT(nameOrig) AS unique_origin_accounts")
    destination = df.select("nameDest").distinct().selectExpr("COUNT(nameDest)")
    return origin.withColumn("unique_destination_accounts", destination.scalar())


def approx_distinct_accounts(df: DataFrame, error: float = 0.01) -> DataFrame:
    """The quick variant: one pass, fixed-size sketches."""
    return df.selectExpr(
        f"approx_count_distinct(nameOrig, {error}) AS unique_origin_accounts",
        f"approx_count_distinct(nameDest, {error}) AS unique_destination_accounts",
    )


def row_hash(columns: list[str]) -> str:
    return f"xxhash64({', '.join(columns)})"


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, exactly.

    Only 64-bit hashes are shuffled first. A hash seen once proves its row
    unique; rows whose hash is seen more often are grouped whole, so a hash
    collision never counts as a duplicate. How the few repeated hashes reach the
    rows is left to the optimiser: it knows their number when the join runs.
    """
    columns = df.columns
    hashed = df.selectExpr("*", f"{row_hash(columns)} AS h")
    repeated = hashed.groupBy("h").count().where("count > 1").select("h")
    groups = hashed.join(repeated, "h", "left_semi").groupBy(*columns).agg(F.expr("COUNT(*) AS __n"))
    return groups.selectExpr(f"COALESCE({total('__n - 1')}, 0) AS duplicate_rows")


# ---- one-row measures ------------------------------------------------------
RULE_CELLS = {
    "tp": count_if(f"{FRAUD} AND {FLAGGED}"),
    "fp": count_if(f"NOT {FRAUD} AND {FLAGGED}"),
    "tn": count_if(f"NOT {FRAUD} AND NOT {FLAGGED}"),
    "fn": count_if(f"{FRAUD} AND NOT {FLAGGED}"),
}


@one_row
def overall_profile(df: DataFrame) -> Summary:
    """The 18 headline measures as (Metric, Value).

    Distinct accounts and duplicates need shuffles of their own; their results
    come in as one-row subqueries.
    """
    measures = {
        "rows": "COUNT(*)",
        "min_step": "MIN(step)",
        "max_step": "MAX(step)",
        "value": total("amount"),
        "min_amount": "MIN(amount)",
        "max_amount": "MAX(amount)",
        "fraud_value": sum_if(FRAUD, "amount"),
        **RULE_CELLS,
    }
    accounts = distinct_accounts(df).selectExpr("struct(*)")
    duplicates = duplicate_rows(df.select(*S.SOURCE_COLUMNS))
    # Metric names of the profile report.
    metrics = [
        ("Total rows", "rows"),
        ("Total columns", str(len(S.SOURCE_COLUMNS))),
        ("Minimum step", "min_step"),
        ("Maximum step", "max_step"),
        ("Total transaction value", "value"),
        ("Average transaction amount", ratio("value", "rows")),
        ("Minimum transaction amount", "min_amount"),
        ("Maximum transaction amount", "max_amount"),
        ("Fraud transactions", "tp + fn"),
        ("Fraud rate (%)", percent_or_zero("tp + fn", "rows")),
        ("Fraud transaction value", "fraud_value"),
        ("Fraud value share (%)", percent_or_zero("fraud_value", "value")),
        ("Flagged transactions", "tp + fp"),
        ("Flag precision (%)", percent_or_zero("tp", "tp + fp")),
        ("Flag recall (%)", percent_or_zero("tp", "tp + fn")),
        ("Unique origin accounts", "accounts.unique_origin_accounts"),
        ("Unique destination accounts", "accounts.unique_destination_accounts"),
        ("Duplicate rows", "duplicates"),
    ]

    def shape(row: DataFrame) -> DataFrame:
        row = row.withColumns({"accounts": accounts.scalar(), "duplicates": duplicates.scalar()})
        return to_long(row, metrics, "Metric", "Value")

    return Summary(measures, shape)


@one_row
def rule_performance(df: DataFrame) -> Summary:
    """Confusion cells, precision and recall of the existing rule."""
    metrics = [
        ("True Positive", "tp"),
        ("False Positive", "fp"),
        ("True Negative", "tn"),
        ("False Negative", "fn"),
        ("Precision (%)", percent_or_zero("tp", "tp + fp")),
        ("Recall / Detection Rate (%)", percent_or_zero("tp", "tp + fn")),
    ]
    return Summary(RULE_CELLS, lambda row: to_long(row, metrics, "Metric", "Value"))


# ---- per column ------------------------------------------------------------
@one_row
def missing_values(
    df: DataFrame, columns: list[str] | None = None, key: str = "Column", share: str = "Missing_Percentage"
) -> Summary:
    """Missing count and percentage per column, in one pass."""
    columns = columns or df.columns
    measures = {"rows": "COUNT(*)", **{f"{c}__n": count_if(missing(df, c)) for c in columns}}
    fields = {"Missing_Count": "{}__n", share: percent_or_zero("{}__n", "rows")}
    return Summary(measures, lambda row: to_rows(row, columns, key, fields))


def column_types(df: DataFrame) -> DataFrame:
    """Column names and Spark types."""
    return df.sparkSession.createDataFrame(df.dtypes, "Column string, Data_Type string")


@one_row
def numeric_summary(df: DataFrame) -> Summary:
    """Range, mean, zero and negative counts of the numeric columns, nulls dropped."""
    measures: dict[str, str] = {}
    for name in S.NUMERIC_COLUMNS:
        value = f"NULLIF({name}, DOUBLE('NaN'))" if is_floating(df, name) else name
        measures |= {
            f"{name}__min": f"MIN({value})",
            f"{name}__max": f"MAX({value})",
            f"{name}__sum": f"SUM({value})",
            f"{name}__n": f"COUNT({value})",
            f"{name}__zero": count_if(f"{name} = 0"),
            f"{name}__neg": count_if(f"{name} < 0"),
        }
    fields = {
        "Minimum": double("{}__min"),
        "Maximum": double("{}__max"),
        "Mean": ratio("{}__sum", "{}__n"),
        "Zero_Count": "{}__zero",
        "Negative_Count": "{}__neg",
    }
    return Summary(measures, lambda row: to_rows(row, S.NUMERIC_COLUMNS, "Column", fields))


def type_profile(df: DataFrame) -> DataFrame:
    """Count, value and fraud share per type; a null type forms no group."""
    grouped = (
        df.where("type IS NOT NULL")
        .groupBy("type")
        .agg(
            F.expr("COUNT(*) AS n"),
            F.expr(f"{total('amount')} AS value"),
            F.expr(f"{count_if(FRAUD)} AS fraud"),
            F.expr(f"{sum_if(FRAUD, 'amount')} AS fraud_value"),
        )
    )
    return grouped.selectExpr(
        "type AS Transaction_Type",
        "n AS Transaction_Count",
        f"{double('value')} AS Transaction_Value",
        "fraud AS Fraud_Count",
        f"{double('fraud_value')} AS Fraud_Value",
        f"{percent_or_zero('fraud', 'n')} AS Fraud_Rate_Pct",
        f"{percent_or_zero('fraud_value', 'value')} AS Fraud_Value_Rate_Pct",
    )


def partial_type_counts(parts: list[DataFrame]) -> DataFrame:
    """Merge per-part counts and values by type, a missing key adding zero.

    On one frame this is simply partial and final aggregation. For parts that
    were counted apart (say one per day), a union and a sum do the merging.
    """
    merged = None
    for part in parts:
        counted = (
            part.where("type IS NOT NULL")
            .groupBy("type")
            .agg(F.expr("COUNT(*) AS row_count"), F.expr("SUM(amount) AS value"))
        )
        merged = counted if merged is None else merged.unionByName(counted)
    summed = merged.groupBy("type").agg(F.expr("SUM(row_count) AS row_count"), F.expr("SUM(value) AS value"))
    return summed.selectExpr("type", "row_count", f"{double('value')} AS value")


def sample_profile(sample: DataFrame) -> DataFrame:
    """Shape, missing counts, duplicates and three value counts of a sample.

    The sample is bounded by its row limit; it is written once for all parts.
    """
    sample = materialise(sample)
    shape = sample.selectExpr("COUNT(*) AS n").selectExpr(
        stack([["'shape'", "'rows'", "n"], ["'shape'", "'columns'", f"{len(sample.columns)}L"]],
              ["Section", "Item", "Value"])
    )
    absent = missing_values(sample).selectExpr(
        "'missing' AS Section", "`Column` AS Item", "Missing_Count AS Value"
    )
    duplicates = duplicate_rows(sample).selectExpr(
        "'duplicates' AS Section", "'rows' AS Item", "duplicate_rows AS Value"
    )
    result = shape.unionByName(absent).unionByName(duplicates)
    for name in ["type", "isFraud", "isFlaggedFraud"]:
        counts = sample.where(f"{name} IS NOT NULL").groupBy(name).count()
        result = result.unionByName(
            counts.selectExpr(f"{text(name)} AS Section", f"CAST({name} AS STRING) AS Item", "count AS Value")
        )
    return result
