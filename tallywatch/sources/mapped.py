"""The supplied order and customer tables read as transactions.

Also deterministic scores on those rows, so that everything after a model
(curves, tiers, queue, views) can be checked exactly without fitting one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import text
from tallywatch.operators.filters import HIGH_RISK

# ---- Fixed values: the columns read; a declared schema needs no footer job --
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CUSTOMERS = "c_custkey long, c_acctbal double"

# ---- Fixed values: order priority to transaction type ----------------------
PRIORITY_TYPES = {
    "1-URGENT": "TRANSFER",
    "2-HIGH": "CASH_OUT",
    "3-MEDIUM": "PAYMENT",
    "4-NOT SPECIFIED": "CASH_IN",
    "5-LOW": "DEBIT",
}

# ---- Fixed values: score rules per model -----------------------------------
# (multiplier, tenths of fraud scored high, noise modulus, noise rows below)
SCORE_RULES = {
    "champion": (7919, 8, 10007, 60),
    "Model_A_Current_Baseline": (7901, 6, 10037, 120),
    "Model_B_Log_Balances_Only": (7907, 7, 10009, 90),
    "Model_C_Balance_Flags_Only": (7883, 5, 10039, 150),
    "Model_D_Enhanced_PaySim": (7877, 9, 10061, 40),
}


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``transaction_id`` and the 11 source columns, money as DECIMAL(20,2)."""
    orders = spark.read.schema(ORDERS).parquet(f"{folder}/orders.parquet")
    customers = spark.read.schema(CUSTOMERS).parquet(f"{folder}/customer.parquet")
    kinds = " ".join(f"WHEN {text(p)} THEN {text(t)}" for p, t in PRIORITY_TYPES.items())
    money = lambda x: f"CAST({x} AS DECIMAL(20,2))"
    keyed = orders.join(customers, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey AS k",
        "o_custkey",
        "c_acctbal",
        f"{money('o_totalprice')} AS price",
        "datediff(o_orderdate, DATE'1995-01-01') AS days",
        f"CASE o_orderpriority {kinds} END AS type",
    )
    priced = keyed.selectExpr(
        "k",
        "CAST(1 + (days * 743) div 2405 AS INT) AS step",
        "type",
        money("CASE WHEN k % 997 = 0 THEN 0 WHEN k % 50 = 1 THEN price * 20 ELSE price END") + " AS amount",
        "concat('C', o_custkey) AS nameOrig",
        money(f"CASE WHEN k % 3 = 0 OR c_acctbal < 0 THEN 0 ELSE {money('c_acctbal')} * 100 END")
        + " AS oldbalanceOrg",
        "concat(CASE WHEN type = 'PAYMENT' THEN 'M' ELSE 'C' END, (o_custkey * 7 + 3) % 1000) AS nameDest",
        money("CASE WHEN k % 7 = 0 THEN 0 ELSE price * 3 END") + " AS oldbalanceDest",
    )
    after = (
        "CASE WHEN k % 4 = 0 THEN 0 WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount "
        "ELSE oldbalanceOrg - amount END"
    )
    fraud = (
        f"{HIGH_RISK} AND (k % 997 = 0 OR k % 50 = 1 OR (amount > 300000 AND k % 5 = 2) OR k % 41 = 0)"
    )
    return priced.selectExpr(
        "k + 1 AS transaction_id",
        "step",
        "type",
        "amount",
        "nameOrig",
        "oldbalanceOrg",
        f"{money(after)} AS newbalanceOrig",
        "nameDest",
        "oldbalanceDest",
        f"{money('oldbalanceDest + amount')} AS newbalanceDest",
        f"CAST({fraud} AS INT) AS isFraud",
        "CAST(type = 'TRANSFER' AND amount > 5000000 AS INT) AS isFlaggedFraud",
    )


def source_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Only the 11 source columns, as in the raw file."""
    return transactions(spark, folder).select(*S.SOURCE_COLUMNS)


def fixed_score(model: str = "champion") -> str:
    """Deterministic score in [0, 1] with four decimals, from key and label."""
    factor, tenths, modulus, below = SCORE_RULES[model]
    k = "(transaction_id - 1)"
    points = (
        f"CASE WHEN isFraud = 1 AND {k} % 10 < {tenths} THEN 9400 + ({k} * {factor}) % 600 "
        f"WHEN ({k} * {factor}) % {modulus} < {below} THEN 9000 + ({k} * {factor}) % 900 "
        f"ELSE ({k} * {factor}) % 8000 END"
    )
    return f"CAST({points} AS DOUBLE) / 10000D"


def with_scores(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Rows with fixed scores; ``scores`` maps a column to a model."""
    return df.selectExpr("*", *[f"{fixed_score(m)} AS {name}" for name, m in scores.items()])


def defective(spark: SparkSession, folder: str) -> DataFrame:
    """Source rows with defects planted by value, for the quality operators.

    Money is double, as in a raw file. Nulls, values outside their domain, blank
    ids, NaN, infinity and negative amounts replace good cells in narrow amount
    ranges; every DEBIT row is there twice.
    """
    within = lambda low, high: f"amount >= {low} AND amount < {high}"
    money = {c: f"CAST({c} AS DOUBLE)" for c in S.MONEY_COLUMNS}
    planted = {
        **money,
        "amount": f"CASE WHEN {within(120000, 122000)} THEN DOUBLE('Infinity') "
        f"WHEN {within(122000, 124000)} THEN DOUBLE('NaN') WHEN {within(124000, 126000)} THEN NULL "
        f"WHEN {within(140000, 142000)} THEN -CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END",
        "step": f"CASE WHEN {within(100000, 102000)} THEN NULL WHEN {within(102000, 104000)} THEN 0 "
        f"WHEN {within(104000, 106000)} THEN 900 ELSE step END",
        "type": f"CASE WHEN {within(110000, 112000)} THEN NULL "
        f"WHEN {within(112000, 114000)} THEN 'REFUND' ELSE type END",
        "nameOrig": f"CASE WHEN {within(130000, 132000)} THEN '' WHEN {within(132000, 134000)} "
        f"THEN ' \\t ' WHEN {within(134000, 136000)} THEN NULL ELSE nameOrig END",
        "nameDest": f"CASE WHEN {within(136000, 138000)} THEN '  ' ELSE nameDest END",
        "isFraud": "CASE WHEN type = 'DEBIT' AND amount > 250000 THEN NULL "
        "WHEN type = 'CASH_IN' AND amount > 450000 THEN 2 ELSE isFraud END",
        "isFlaggedFraud": "CASE WHEN type = 'PAYMENT' AND amount > 450000 THEN NULL ELSE isFlaggedFraud END",
    }
    rows = transactions(spark, folder).selectExpr(
        *[f"{planted.get(c, c)} AS {c}" for c in S.SOURCE_COLUMNS],
        "explode(CASE WHEN type = 'DEBIT' THEN array(1, 2) ELSE array(1) END) AS copy",
    )
    return rows.select(*S.SOURCE_COLUMNS)
