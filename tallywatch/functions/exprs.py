"""SQL expression texts: null rules, guarded ratios, bands, tiers, reshaping.

Everything is a built-in Spark expression, so it stays inside whole-stage code
generation and needs no user function. Texts rather than Column objects: a text
is parsed in one call, while every Column operator is a call of its own from
Python to the JVM, which adds up to seconds of plan building for wide tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, types as T

from tallywatch import schema as S


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(x: str, values: Iterable) -> str:
    items = ", ".join(text(v) if isinstance(v, str) else str(v) for v in values)
    return f"({x} IN ({items}))"


# ---- null and NaN rules ----------------------------------------------------
def flag(condition: str) -> str:
    """0/1 as a byte; a comparison with a null is 0, never null."""
    return f"CAST(COALESCE({condition}, FALSE) AS TINYINT)"


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> str:
    """Null, or NaN in a floating column (a blank numeric cell is NaN)."""
    return f"({name} IS NULL OR isnan({name}))" if is_floating(df, name) else f"({name} IS NULL)"


def infinite(x: str) -> str:
    return f"COALESCE(abs({double(x)}) = DOUBLE('Infinity'), FALSE)"


def non_finite(x: str) -> str:
    """Null, NaN or infinite."""
    return f"({x} IS NULL OR isnan({double(x)}) OR abs({double(x)}) = DOUBLE('Infinity'))"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so aggregates skip it."""
    return df.selectExpr(
        *[
            f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" if is_floating(df, c) else c
            for c in df.columns
        ]
    )


def is_one(x: str) -> str:
    """True only for 1; null counts as not one, so its negation keeps nulls."""
    return f"({x} <=> 1)"


def blank(x: str) -> str:
    """Null, empty or all whitespace (tabs and line ends included)."""
    return f"({x} IS NULL OR rlike({x}, r'^\\s*$'))"


def prefix(x: str) -> str:
    return f"substring({x}, 1, 1)"


# ---- guarded ratios --------------------------------------------------------
def ratio(a: str, b: str) -> str:
    """Double division, NULL over zero."""
    return f"({double(a)} / NULLIF({double(b)}, 0D))"


def ratio_or_zero(a: str, b: str) -> str:
    return f"COALESCE({ratio(a, b)}, 0D)"


def percent(a: str, b: str) -> str:
    """Percentage, NULL over zero."""
    return f"({ratio(a, b)} * 100D)"


def percent_or_zero(a: str, b: str) -> str:
    return f"COALESCE({percent(a, b)}, 0D)"


def rounded_percent(a: str, b: str, places: int) -> str:
    """Percentage rounded half away from zero on decimals; NULL over zero."""
    exact = lambda x: f"CAST({x} AS DECIMAL(30,4))"
    return double(f"round({exact(a)} * 100 / NULLIF({exact(b)}, {exact('0')}), {places})")


def rounded(x: str, places: int) -> str:
    """Round a double half away from zero, by way of a decimal."""
    return double(f"round(CAST({x} AS DECIMAL(38,15)), {places})")


def odds_ratio(x: str) -> str:
    return f"exp(greatest(-20D, least(20D, {double(x)})))"


def curve_f2(p: str, r: str) -> str:
    """F2 as the threshold search computes it: a tiny constant, no guard."""
    return f"(5D * {p} * {r} / (4D * {p} + {r} + 1e-12D))"


# ---- conditional aggregates ------------------------------------------------
def count_if(condition: str) -> str:
    return f"COUNT_IF({condition})"


def sum_if(condition: str, x: str) -> str:
    """Sum over matching rows; an empty match gives 0."""
    return f"COALESCE(SUM({x}) FILTER (WHERE {condition}), 0)"


def total(x: str) -> str:
    return f"COALESCE(SUM({x}), 0)"


# ---- categories ------------------------------------------------------------
def amount_band(x: str) -> str:
    """Nine right-closed bands; below the lower edge, null and NaN have no band.

    The money column is compared as it is: a cast would be repeated per arm.
    """
    arms = [f"WHEN {x} < {S.BAND_FLOOR} THEN NULL"]
    for label, upper in S.AMOUNT_BANDS:
        test = f"{x} <= {upper}" if upper is not None else f"{x} IS NOT NULL AND NOT isnan({double(x)})"
        arms.append(f"WHEN {test} THEN {text(label)}")
    return f"CASE {' '.join(arms)} END"


def risk_tier(score: str, critical: str, high: str, medium: str) -> str:
    """First match of the three thresholds, else Low."""
    return (
        f"CASE WHEN {score} >= {critical} THEN 'Critical' WHEN {score} >= {high} THEN 'High' "
        f"WHEN {score} >= {medium} THEN 'Medium' ELSE 'Low' END"
    )


def tier_sort(tier: str) -> str:
    arms = " ".join(f"WHEN {text(t)} THEN {i}" for i, t in enumerate(S.TIERS, start=1))
    return f"CASE {tier} {arms} END"


def recommended_action(score: str, immediate: float = 0.99, urgent: float = 0.98) -> str:
    return (
        f"CASE WHEN {score} >= {immediate}D THEN 'Immediate Review' "
        f"WHEN {score} >= {urgent}D THEN 'Urgent Review' ELSE 'Priority Review' END"
    )


# ---- reshaping -------------------------------------------------------------
def stack(rows: Sequence[Sequence[str]], names: Sequence[str]) -> str:
    """A generator of literal rows of expressions."""
    cells = ", ".join(cell for row in rows for cell in row)
    return f"stack({len(rows)}, {cells}) AS ({', '.join(f'`{n}`' for n in names)})"


def listed(df: DataFrame, rows: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """A small constant table in the JVM, next to ``df``'s session."""
    return df.sparkSession.range(1).selectExpr(stack(rows, names))


def to_long(
    row: DataFrame, pairs: Sequence[tuple[str, str]], key: str, value: str, kind: str = "DOUBLE"
) -> DataFrame:
    """One wide row to (key, value) rows."""
    return row.selectExpr(stack([(text(k), f"CAST({x} AS {kind})") for k, x in pairs], [key, value]))


def to_rows(
    row: DataFrame, labels: Iterable[str], key: str, fields: dict[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """One wide row to one row per label.

    ``fields`` maps an output name to an expression in which ``{}`` stands for
    the label.
    """
    rows = [[text(label)] + [x.replace("{}", label) for x in fields.values()] for label in labels]
    return row.selectExpr(*keep, stack(rows, [key, *fields]))
