"""Filters and predicates. All of them are plain expressions that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywatch import schema as S
from tallywatch.functions.exprs import any_of, blank, is_one, text

HIGH_RISK = any_of("type", S.HIGH_RISK_TYPES)

# ---- masks and domain checks -----------------------------------------------
#: True for label 1; null counts as not fraud (so NOT keeps it).
FRAUD = is_one("isFraud")
FLAGGED = is_one("isFlaggedFraud")
INVALID_STEP = f"(step IS NULL OR step NOT BETWEEN {S.FIRST_STEP} AND {S.LAST_STEP})"
INVALID_TYPE = f"(type IS NULL OR NOT {any_of('type', S.ALLOWED_TYPES)})"


def invalid_label(name: str) -> str:
    return f"({name} IS NULL OR {name} NOT IN (0, 1))"


def blank_identifier(name: str) -> str:
    return blank(name)


# ---- population and periods ------------------------------------------------
def high_risk(df: DataFrame) -> DataFrame:
    """TRANSFER and CASH_OUT rows."""
    return df.where(HIGH_RISK)


def split_name(train_end: int, validation_end: int) -> str:
    """TRAIN / VALIDATION / TEST from the step; null step has no split."""
    return (
        f"CASE WHEN step <= {train_end} THEN 'TRAIN' WHEN step <= {validation_end} THEN 'VALIDATION' "
        f"WHEN step > {validation_end} THEN 'TEST' END"
    )


def in_split(df: DataFrame, split: str, train_end: int, validation_end: int) -> DataFrame:
    """One split by a plain range on ``step``, which reaches the scan."""
    ranges = {
        "TRAIN": f"step <= {train_end}",
        "VALIDATION": f"step > {train_end} AND step <= {validation_end}",
        "TEST": f"step > {validation_end}",
    }
    return df.where(ranges[split])


def scoring_period(df: DataFrame, after: int, until: int | None = None) -> DataFrame:
    """High-risk rows of a period of the master table."""
    period = f"step > {after}" if until is None else f"step > {after} AND step <= {until}"
    return df.where(f"{HIGH_RISK} AND {period}")


def alerts(scored: DataFrame) -> DataFrame:
    return scored.where("operational_alert = 1")


def model_row(table: DataFrame, equals: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows of a model table by name or by part of the name; null never matches."""
    if equals is not None:
        return table.where(f"Model = {text(equals)}")
    return table.where(f"contains(Model, {text(contains)})")
