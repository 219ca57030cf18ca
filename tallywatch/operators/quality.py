"""Data-quality counters, cleaning rules, constraints and the leakage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import (
    any_of, count_if, double, non_finite, percent_or_zero, prefix, text, to_long, to_rows, total,
)
from tallywatch.operators import filters as flt
from tallywatch.operators.onepass import Summary, one_row
from tallywatch.session import scratch_path

# ---- counters --------------------------------------------------------------
ZERO_AMOUNT_COUNTERS = {
    "zero_amount_count": count_if("amount = 0"),
    "negative_amount_count": count_if("amount < 0"),
    "zero_amount_fraud": count_if("amount = 0 AND isFraud = 1"),
    "zero_amount_legitimate": count_if("amount = 0 AND isFraud = 0"),
}

_OUTGOING = any_of("type", S.OUTGOING_TYPES)
_OUT_GAP = double("abs(oldbalanceOrg - newbalanceOrig - amount)")
_IN_GAP = double("abs(newbalanceOrig - oldbalanceOrg - amount)")
_CASH_IN = "type = 'CASH_IN'"
BALANCE_COUNTERS = {
    "out_checked": count_if(_OUTGOING),
    "out_mismatch": count_if(f"{_OUTGOING} AND {_OUT_GAP} > {S.BALANCE_TOLERANCE}D"),
    "in_checked": count_if(_CASH_IN),
    "in_mismatch": count_if(f"{_CASH_IN} AND {_IN_GAP} > {S.BALANCE_TOLERANCE}D"),
}

#: Cells, not rows, that are null, NaN or infinite in the numeric columns.
NON_FINITE_CELLS = " + ".join(count_if(non_finite(c)) for c in S.NUMERIC_COLUMNS)


@one_row
def quality_audit(df: DataFrame) -> Summary:
    """The 14 checks as (Check, Count), from one pass."""
    measures = {
        "rows": "COUNT(*)",
        **ZERO_AMOUNT_COUNTERS,
        "bad_step": count_if(flt.INVALID_STEP),
        "bad_type": count_if(flt.INVALID_TYPE),
        "bad_fraud": count_if(flt.invalid_label("isFraud")),
        "bad_flagged": count_if(flt.invalid_label("isFlaggedFraud")),
        "blank_origin": count_if(flt.blank_identifier("nameOrig")),
        "blank_destination": count_if(flt.blank_identifier("nameDest")),
        "non_finite": NON_FINITE_CELLS,
        **BALANCE_COUNTERS,
    }
    # Check names of the audit.
    checks = [
        ("Total rows", "rows"),
        ("Zero transaction amounts", "zero_amount_count"),
        ("Negative transaction amounts", "negative_amount_count"),
        ("Zero-amount fraud transactions", "zero_amount_fraud"),
        ("Zero-amount legitimate transactions", "zero_amount_legitimate"),
        ("Invalid step values", "bad_step"),
        ("Invalid transaction types", "bad_type"),
        ("Invalid isFraud values", "bad_fraud"),
        ("Invalid isFlaggedFraud values", "bad_flagged"),
        ("Blank origin IDs", "blank_origin"),
        ("Blank destination IDs", "blank_destination"),
        ("Non-finite numeric values", "non_finite"),
        ("Outgoing origin-balance mismatches", "out_mismatch"),
        ("CASH_IN origin-balance mismatches", "in_mismatch"),
    ]
    return Summary(measures, lambda row: to_long(row, checks, "Check", "Count", "BIGINT"))


@one_row
def zero_amounts(df: DataFrame) -> Summary:
    return Summary(ZERO_AMOUNT_COUNTERS, lambda row: row)


@one_row
def non_finite_count(df: DataFrame) -> Summary:
    return Summary({"nonfinite_numeric_count": NON_FINITE_CELLS}, lambda row: row)


@one_row
def balance_summary(df: DataFrame) -> Summary:
    """Zero count, zero share and negative count of the four balances."""
    measures = {"rows": "COUNT(*)"}
    for name in S.BALANCE_COLUMNS:
        measures |= {f"{name}__zero": count_if(f"{name} = 0"), f"{name}__neg": count_if(f"{name} < 0")}
    fields = {
        "Zero_Count": "{}__zero",
        "Zero_Percentage": percent_or_zero("{}__zero", "rows"),
        "Negative_Count": "{}__neg",
    }
    return Summary(measures, lambda row: to_rows(row, S.BALANCE_COLUMNS, "Column", fields))


def prefix_summary(df: DataFrame) -> DataFrame:
    """Origin and destination counts per first character of the account id.

    A full outer join of two counted tables of a few rows each. A null id gives
    a NULL prefix, matched null-safely.
    """
    origin = df.groupBy(F.expr(f"{prefix('nameOrig')} AS o")).agg(F.expr("COUNT(*) AS origin_n"))
    destination = df.groupBy(F.expr(f"{prefix('nameDest')} AS d")).agg(F.expr("COUNT(*) AS dest_n"))
    return origin.join(destination, F.expr("o <=> d"), "full_outer").selectExpr(
        "COALESCE(o, d) AS Prefix",
        "COALESCE(origin_n, 0) AS Origin_Count",
        "COALESCE(dest_n, 0) AS Destination_Count",
    )


def high_value_profile(df: DataFrame) -> DataFrame:
    """Transactions, those above 200,000 and their fraud, per type."""
    high = f"amount > {S.HIGH_VALUE}"
    return (
        df.where("type IS NOT NULL")
        .groupBy(F.expr("type AS Transaction_Type"))
        .agg(
            F.expr("COUNT(*) AS Total_Transactions"),
            F.expr(f"{count_if(high)} AS Transactions_Above_200k"),
            F.expr(f"{count_if(f'{high} AND {flt.FRAUD}')} AS Fraud_Above_200k"),
        )
    )


def high_value_by_type(df: DataFrame) -> DataFrame:
    """The same from two tables: every observed type, left-joined to its
    high-value counts. For inputs whose high-value rows are kept apart."""
    known = df.where("type IS NOT NULL")
    types = known.groupBy("type").agg(F.expr("COUNT(*) AS n"))
    high = (
        known.where(f"amount > {S.HIGH_VALUE}")
        .groupBy("type")
        .agg(F.expr("COUNT(*) AS high_n"), F.expr(f"{count_if(flt.FRAUD)} AS high_fraud"))
    )
    return types.join(high, "type", "left").selectExpr(
        "type AS Transaction_Type",
        "n AS Total_Transactions",
        "COALESCE(high_n, 0) AS Transactions_Above_200k",
        "COALESCE(high_fraud, 0) AS Fraud_Above_200k",
    )


@one_row
def balance_consistency(df: DataFrame) -> Summary:
    checks = [
        ("Outgoing transactions checked", "out_checked"),
        ("Outgoing origin-balance mismatches", "out_mismatch"),
        ("CASH_IN transactions checked", "in_checked"),
        ("CASH_IN origin-balance mismatches", "in_mismatch"),
    ]
    return Summary(BALANCE_COUNTERS, lambda row: to_long(row, checks, "Check", "Count", "BIGINT"))


# ---- cleaning rules --------------------------------------------------------
#: Exclusion rules in order: name and the test a row must not meet.
EXCLUSION_RULES = {
    "negative_amount": "amount < 0",
    "invalid_type": flt.INVALID_TYPE,
    "invalid_step": flt.INVALID_STEP,
    "invalid_label": flt.invalid_label("isFraud"),
    "invalid_existing_flag": flt.invalid_label("isFlaggedFraud"),
    "blank_account": f"{flt.blank_identifier('nameOrig')} OR {flt.blank_identifier('nameDest')}",
}


def judge_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with a ``reason`` array: the exclusion rules each one breaks.

    Zero balances, balance mismatches and very large amounts stay without a
    reason. Equal rows fold on the map side, so a row copied very often is no
    hot partition.
    """
    names = ", ".join(f"CASE WHEN {test} THEN {text(n)} END" for n, test in EXCLUSION_RULES.items())
    return df.dropDuplicates().selectExpr("*", f"array_compact(array({names})) AS reason")


def apply_cleaning_rules(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows (with their reasons).

    The judged rows are written once, so that reading both sides does not drop
    duplicates twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "judged")
    marked = judge_rows(df).selectExpr("*", "CAST(size(reason) = 0 AS INT) AS valid")
    marked.write.partitionBy("valid").parquet(path)
    judged = spark.read.parquet(path)
    return judged.where("valid = 1").drop("reason", "valid"), judged.where("valid = 0").drop("valid")


# ---- constraints and leakage -----------------------------------------------
def constraint_violations(
    df: DataFrame, key: str, required: list[str], flags: list[str], domains: dict[str, list]
) -> DataFrame:
    """Violation counts of key, not-null, 0/1 and value-list constraints."""
    checks = [(f"not_null:{c}", f"{c} IS NULL") for c in required]
    checks += [(f"flag:{c}", f"{c} NOT IN (0, 1)") for c in flags]
    checks += [(f"domain:{c}", f"NOT {any_of(c, values)}") for c, values in domains.items()]
    row = df.selectExpr(*[f"{count_if(test)} AS c{i}" for i, (_, test) in enumerate(checks)])
    keys = df.groupBy(key).agg(F.expr("COUNT(*) AS n"))
    row = row.withColumn("repeated", keys.selectExpr(total("n - 1")).scalar())
    pairs = [(f"unique:{key}", "repeated")]
    pairs += [(name, f"c{i}") for i, (name, _) in enumerate(checks)]
    return to_long(row, pairs, "constraint_name", "violations", "BIGINT")


class LeakageError(ValueError):
    """A frame meant for a model carries columns a model must not see."""


def leakage_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Per column of each frame: whether a model must not see it, and how many rows have a value in it."""
    report = None
    for name, frame in frames.items():
        row = frame.selectExpr(*[f"COUNT(`{c}`) AS c{i}" for i, c in enumerate(frame.columns)])
        listed = ", ".join(
            f"struct({text(name)} AS table_name, {text(c)} AS column_name, {int(c in S.LEAKAGE_COLUMNS)} AS leaks, c{i} AS filled_rows)"
            for i, c in enumerate(frame.columns)
        )
        part = row.selectExpr(f"inline(array({listed}))")
        report = part if report is None else report.unionByName(part)
    return report


def leakage_guard(df: DataFrame) -> DataFrame:
    """Return the frame unchanged, or raise if it carries leaking columns."""
    found = [c for c in df.columns if c in S.LEAKAGE_COLUMNS]
    if found:
        raise LeakageError(f"columns not allowed in a model frame: {', '.join(found)}")
    return df
