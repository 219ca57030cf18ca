"""Engineered columns: one projection per table, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywatch import schema as S
from tallywatch.functions.exprs import double, flag, ratio
from tallywatch.operators.filters import high_risk

#: Gap between the expected and the recorded origin balance after.
BALANCE_ERROR = double(
    "abs(CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END"
    " - newbalanceOrig)"
)

#: The 13 engineered columns over the source columns.
ENGINEERED = {
    "transaction_day": "CAST(floor((step - 1) / 24) + 1 AS SMALLINT)",
    "hour_of_day": "CAST(pmod(step - 1, 24) AS TINYINT)",
    "log_amount": f"log1p({double('amount')})",
    "zero_amount_flag": flag("amount = 0"),
    "high_value_200k_flag": flag(f"amount > {S.HIGH_VALUE}"),
    "origin_zero_before_flag": flag("oldbalanceOrg = 0"),
    "destination_zero_before_flag": flag("oldbalanceDest = 0"),
    "amount_exceeds_origin_balance_flag": flag("amount > oldbalanceOrg"),
    "destination_is_merchant": flag("startswith(nameDest, 'M')"),
    "amount_to_origin_balance_ratio": ratio("amount", "oldbalanceOrg"),
    "amount_to_destination_balance_ratio": ratio("amount", "oldbalanceDest"),
    "origin_balance_error_abs": BALANCE_ERROR,
    "origin_balance_mismatch_flag": flag(f"{BALANCE_ERROR} > {S.BALANCE_TOLERANCE}D"),
}

_ANGLE = "hour_of_day * 2D * pi() / 24D"

#: Every feature any model uses, over the model population.
MODEL_FEATURES = {
    "type_transfer_flag": flag("type = 'TRANSFER'"),
    "log_amount": "CAST(log_amount AS FLOAT)",
    "log_oldbalanceOrg": f"CAST(log1p({double('oldbalanceOrg')}) AS FLOAT)",
    "log_oldbalanceDest": f"CAST(log1p({double('oldbalanceDest')}) AS FLOAT)",
    "hour_sin": f"CAST(sin({_ANGLE}) AS FLOAT)",
    "hour_cos": f"CAST(cos({_ANGLE}) AS FLOAT)",
    **{name: f"CAST({name} AS TINYINT)" for name in S.RISK_FLAGS},
}


def master_dataset(df: DataFrame) -> DataFrame:
    """Id, 11 source columns and 13 engineered ones; no row is dropped."""
    labels = ("isFraud", "isFlaggedFraud")
    source = [f"CAST({c} AS TINYINT) AS {c}" if c in labels else c for c in S.SOURCE_COLUMNS]
    made = [f"{expression} AS {name}" for name, expression in ENGINEERED.items()]
    return df.selectExpr("transaction_id", *source, *made)


def model_population(master: DataFrame) -> DataFrame:
    """High-risk rows with the 18 columns allowed for modelling."""
    return high_risk(master).select(*S.MODEL_COLUMNS)


def model_features(
    df: DataFrame, features: list[str], keep: tuple[str, ...] = ("transaction_id", "step")
) -> DataFrame:
    """Key, step, the chosen features and the label as one projection."""
    made = [f"{MODEL_FEATURES[name]} AS {name}" for name in features]
    return df.selectExpr(*keep, *made, "CAST(isFraud AS TINYINT) AS isFraud")
