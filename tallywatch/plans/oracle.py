"""DuckDB SQL for the named queries, written apart from the Spark code.

``WITH`` blocks are shared: ``t`` transactions, ``d`` the defective copy, ``m``
master, ``h`` model population, ``sb`` split boundaries, ``s`` scored rows,
``v`` and ``te`` validation and test, ``vc`` and ``tc`` their curves, ``th``
thresholds, ``x`` tiered test rows, ``q`` the queue, ``f`` the fact.
"""

from __future__ import annotations

import re

from tallywatch import schema as S
from tallywatch.report.tables import TABLE_COLUMNS, TABLE_DOMAINS, TABLE_FLAGS
from tallywatch.sources.mapped import SCORE_RULES

CHAMPION = "HistGradientBoosting - Defensible Features"
CHALLENGER = "Logistic Regression - Model B"
RULE = "Existing isFlaggedFraud Rule"
MODEL_B = "Model_B_Log_Balances_Only"
_MASTER_COLUMNS = [
    "transaction_id", *S.SOURCE_COLUMNS, "transaction_day", "hour_of_day", "log_amount", *S.RISK_FLAGS,
    "amount_to_origin_balance_ratio", "amount_to_destination_balance_ratio",
    "origin_balance_error_abs", "origin_balance_mismatch_flag",
]


# ---- text helpers ----------------------------------------------------------
def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places})"


def div(a: str, b: str) -> str:
    return f"({d(a)} / NULLIF({d(b)}, 0))"


def div0(a: str, b: str) -> str:
    return f"COALESCE({div(a, b)}, 0)"


def pct(a: str, b: str) -> str:
    return f"({div(a, b)} * 100)"


def pct0(a: str, b: str) -> str:
    return f"COALESCE({pct(a, b)}, 0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def cnt(condition: str) -> str:
    return big(f"COUNT(*) FILTER (WHERE {condition})")


def half_up(numerator: str, denominator: str, places: int, scale: int = 1) -> str:
    """scale * a / b rounded half up on integers; NULL over zero."""
    k = scale * 10**places
    a, b = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return f"(CASE WHEN {b} = 0 THEN NULL ELSE {d(f'(2 * {k} * {a} + {b}) // (2 * {b})')} / {d(str(10**places))} END)"


def rpct(a: str, b: str, places: int) -> str:
    return half_up(a, b, places, 100)


def cents(x: str) -> str:
    return f"CAST({x} * 100 AS HUGEINT)"


def longform(pairs: list[tuple[str, str]], key: str, value: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS {key}, {expr} AS {value} FROM {source}" for label, expr in pairs)


# ---- shared blocks ---------------------------------------------------------
_BLOCKS: list[tuple[str, str]] = [
    (
        "b0",
        """SELECT o_orderkey AS k, o_custkey AS ck, CAST(o_totalprice AS DECIMAL(20,2)) AS price,
        date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
        o_orderpriority AS pr, c_acctbal AS bal
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    (
        "b1",
        """SELECT k, ck, k + 1 AS transaction_id, CAST(1 + (days * 743) // 2405 AS INTEGER) AS step,
        CASE pr WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'
          WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' WHEN '5-LOW' THEN 'DEBIT' END AS type,
        CAST(CASE WHEN k % 997 = 0 THEN 0 WHEN k % 50 = 1 THEN price * 20 ELSE price END AS DECIMAL(20,2)) AS amount,
        CAST(CASE WHEN k % 3 = 0 OR bal < 0 THEN 0 ELSE CAST(bal AS DECIMAL(20,2)) * 100 END AS DECIMAL(20,2)) AS oldbalanceOrg,
        CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE price * 3 END AS DECIMAL(20,2)) AS oldbalanceDest
        FROM b0""",
    ),
    (
        "t",
        """SELECT transaction_id, step, type, amount, 'C' || ck AS nameOrig, oldbalanceOrg,
        CAST(CASE WHEN k % 4 = 0 THEN 0 WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount
          ELSE oldbalanceOrg - amount END AS DECIMAL(20,2)) AS newbalanceOrig,
        (CASE WHEN type = 'PAYMENT' THEN 'M' ELSE 'C' END) || ((ck * 7 + 3) % 1000) AS nameDest,
        oldbalanceDest, CAST(oldbalanceDest + amount AS DECIMAL(20,2)) AS newbalanceDest,
        CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND (k % 997 = 0 OR k % 50 = 1
          OR (amount > 300000 AND k % 5 = 2) OR k % 41 = 0) THEN 1 ELSE 0 END AS isFraud,
        CASE WHEN type = 'TRANSFER' AND amount > 5000000 THEN 1 ELSE 0 END AS isFlaggedFraud
        FROM b1""",
    ),
    (
        "d0",
        """SELECT
        CASE WHEN amount >= 100000 AND amount < 102000 THEN NULL WHEN amount >= 102000 AND amount < 104000 THEN 0
          WHEN amount >= 104000 AND amount < 106000 THEN 900 ELSE step END AS step,
        CASE WHEN amount >= 110000 AND amount < 112000 THEN NULL
          WHEN amount >= 112000 AND amount < 114000 THEN 'REFUND' ELSE type END AS type,
        CASE WHEN amount >= 120000 AND amount < 122000 THEN 'inf'::DOUBLE
          WHEN amount >= 122000 AND amount < 124000 THEN 'nan'::DOUBLE
          WHEN amount >= 124000 AND amount < 126000 THEN NULL
          WHEN amount >= 140000 AND amount < 142000 THEN -CAST(amount AS DOUBLE)
          ELSE CAST(amount AS DOUBLE) END AS amount,
        CASE WHEN amount >= 130000 AND amount < 132000 THEN '' WHEN amount >= 132000 AND amount < 134000 THEN ' ' || chr(9) || ' '
          WHEN amount >= 134000 AND amount < 136000 THEN NULL ELSE nameOrig END AS nameOrig,
        CAST(oldbalanceOrg AS DOUBLE) AS oldbalanceOrg, CAST(newbalanceOrig AS DOUBLE) AS newbalanceOrig,
        CASE WHEN amount >= 136000 AND amount < 138000 THEN '  ' ELSE nameDest END AS nameDest,
        CAST(oldbalanceDest AS DOUBLE) AS oldbalanceDest, CAST(newbalanceDest AS DOUBLE) AS newbalanceDest,
        CASE WHEN type = 'DEBIT' AND amount > 250000 THEN NULL WHEN type = 'CASH_IN' AND amount > 450000 THEN 2
          ELSE isFraud END AS isFraud,
        CASE WHEN type = 'PAYMENT' AND amount > 450000 THEN NULL ELSE isFlaggedFraud END AS isFlaggedFraud,
        type = 'DEBIT' AS twice
        FROM t""",
    ),
    ("d", "SELECT * EXCLUDE (twice) FROM d0 UNION ALL SELECT * EXCLUDE (twice) FROM d0 WHERE twice"),
    (
        "m",
        """SELECT transaction_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
        oldbalanceDest, newbalanceDest, CAST(isFraud AS TINYINT) AS isFraud,
        CAST(isFlaggedFraud AS TINYINT) AS isFlaggedFraud,
        CAST((step - 1) // 24 + 1 AS SMALLINT) AS transaction_day, CAST((step - 1) % 24 AS TINYINT) AS hour_of_day,
        ln(1 + CAST(amount AS DOUBLE)) AS log_amount,
        CAST(amount = 0 AS TINYINT) AS zero_amount_flag, CAST(amount > 200000 AS TINYINT) AS high_value_200k_flag,
        CAST(oldbalanceOrg = 0 AS TINYINT) AS origin_zero_before_flag,
        CAST(oldbalanceDest = 0 AS TINYINT) AS destination_zero_before_flag,
        CAST(amount > oldbalanceOrg AS TINYINT) AS amount_exceeds_origin_balance_flag,
        CAST(nameDest LIKE 'M%' AS TINYINT) AS destination_is_merchant,
        CAST(amount AS DOUBLE) / NULLIF(CAST(oldbalanceOrg AS DOUBLE), 0) AS amount_to_origin_balance_ratio,
        CAST(amount AS DOUBLE) / NULLIF(CAST(oldbalanceDest AS DOUBLE), 0) AS amount_to_destination_balance_ratio,
        CAST(abs((CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END) - newbalanceOrig) AS DOUBLE) AS origin_balance_error_abs,
        CAST(abs((CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END) - newbalanceOrig) > 0.01 AS TINYINT) AS origin_balance_mismatch_flag
        FROM t""",
    ),
    (
        "h",
        f"SELECT {', '.join(S.MODEL_COLUMNS)} FROM m WHERE type IN ('TRANSFER', 'CASH_OUT')",
    ),
    (
        "g",
        """SELECT transaction_id, step, isFraud, transaction_day, hour_of_day, zero_amount_flag, high_value_200k_flag,
        origin_zero_before_flag, destination_zero_before_flag, amount_exceeds_origin_balance_flag, destination_is_merchant,
        CAST(type = 'TRANSFER' AS TINYINT) AS type_transfer_flag,
        CAST(CAST(log_amount AS FLOAT) AS DOUBLE) AS log_amount,
        CAST(CAST(ln(1 + CAST(oldbalanceOrg AS DOUBLE)) AS FLOAT) AS DOUBLE) AS log_oldbalanceOrg,
        CAST(CAST(ln(1 + CAST(oldbalanceDest AS DOUBLE)) AS FLOAT) AS DOUBLE) AS log_oldbalanceDest,
        CAST(CAST(sin(hour_of_day * 2 * pi() / 24) AS FLOAT) AS DOUBLE) AS hour_sin,
        CAST(CAST(cos(hour_of_day * 2 * pi() / 24) AS FLOAT) AS DOUBLE) AS hour_cos
        FROM h""",
    ),
    (
        "sp",
        """SELECT step, CAST(row_count AS BIGINT) AS row_count,
        CAST(SUM(row_count) OVER (ORDER BY step) AS BIGINT) AS cumulative_rows,
        CAST(SUM(row_count) OVER () AS BIGINT) AS total_rows
        FROM (SELECT step, COUNT(*) AS row_count FROM h GROUP BY step)""",
    ),
    (
        "s1",
        """SELECT step AS train_end FROM sp
        ORDER BY abs(CAST(cumulative_rows AS DOUBLE) - CAST(total_rows AS DOUBLE) * CAST(0.7 AS DOUBLE)), step LIMIT 1""",
    ),
    (
        "sb",
        """SELECT (SELECT train_end FROM s1) AS train_end, step AS validation_end FROM sp
        WHERE step > (SELECT train_end FROM s1)
        ORDER BY abs(CAST(cumulative_rows AS DOUBLE) - CAST(total_rows AS DOUBLE) * CAST(0.7999999999999999 AS DOUBLE)), step LIMIT 1""",
    ),
]


def _score(model: str) -> str:
    a, keep, modulus, below = SCORE_RULES[model]
    k = "(transaction_id - 1)"
    return (
        f"CAST(CASE WHEN isFraud = 1 AND {k} % 10 < {keep} THEN 9400 + ({k} * {a}) % 600 "
        f"WHEN ({k} * {a}) % {modulus} < {below} THEN 9000 + ({k} * {a}) % 900 "
        f"ELSE ({k} * {a}) % 8000 END AS DOUBLE) / CAST(10000 AS DOUBLE)"
    )


def _curve(source: str, score: str) -> str:
    return (
        f"SELECT score, n, pos, {big('SUM(n) OVER (ORDER BY score DESC)')} AS alerts, "
        f"{big('SUM(pos) OVER (ORDER BY score DESC)')} AS tp, {big('ROW_NUMBER() OVER (ORDER BY score DESC)')} AS place "
        f"FROM (SELECT {score} AS score, {big('COUNT(*)')} AS n, {big('SUM(isFraud)')} AS pos FROM {source} GROUP BY 1)"
    )


def _pr(curve: str) -> str:
    p, rc = "(CAST(tp AS DOUBLE) / alerts)", f"(CAST(tp AS DOUBLE) / (SELECT MAX(tp) FROM {curve}))"
    return (
        f"SELECT score AS Threshold, {p} AS Precision, {rc} AS Recall, place, "
        f"CAST(5 AS DOUBLE) * {p} * {rc} / (CAST(4 AS DOUBLE) * {p} + {rc} + CAST(1e-12 AS DOUBLE)) AS F2 FROM {curve}"
    )


_MODELS = {"c": "champion", "a": "Model_A_Current_Baseline", "lb": MODEL_B,
           "lc": "Model_C_Balance_Flags_Only", "ld": "Model_D_Enhanced_PaySim"}
_BLOCKS += [
    (
        "s",
        "SELECT m.*, " + ", ".join(f"{_score(m)} AS score_{k}" for k, m in _MODELS.items())
        + " FROM m WHERE type IN ('TRANSFER', 'CASH_OUT')",
    ),
    ("v", "SELECT * FROM s WHERE step > (SELECT train_end FROM sb) AND step <= (SELECT validation_end FROM sb)"),
    ("te", "SELECT * FROM s WHERE step > (SELECT validation_end FROM sb)"),
]
for _k in _MODELS:
    _BLOCKS += [
        (f"vc_{_k}", _curve("v", f"score_{_k}")),
        (f"vp_{_k}", _pr(f"vc_{_k}")),
        (f"best_{_k}", f"SELECT Threshold, Precision, Recall, F2 FROM vp_{_k} ORDER BY F2 DESC, Threshold LIMIT 1"),
        (f"tc_{_k}", _curve("te", f"score_{_k}")),
    ]
_BLOCKS += [
    (
        "th",
        """SELECT quantile_cont(score_c, 0.95) AS medium, quantile_cont(score_c, 0.99) AS high,
        quantile_cont(score_c, 0.995) AS critical, (SELECT Threshold FROM best_c) AS operating FROM v""",
    ),
    (
        "x",
        """SELECT te.* EXCLUDE (score_c), score_c AS hgb_fraud_score,
        CASE WHEN score_c >= critical THEN 'Critical' WHEN score_c >= high THEN 'High'
          WHEN score_c >= medium THEN 'Medium' ELSE 'Low' END AS risk_tier,
        CAST(score_c >= operating AS TINYINT) AS operational_alert
        FROM te, th""",
    ),
    (
        "q",
        """SELECT ROW_NUMBER() OVER (ORDER BY hgb_fraud_score DESC, amount DESC, transaction_id) AS investigation_rank,
        transaction_id, step, transaction_day, hour_of_day, type, CAST(amount AS DOUBLE) AS amount, nameOrig, nameDest,
        CAST(oldbalanceOrg AS DOUBLE) AS oldbalanceOrg, CAST(oldbalanceDest AS DOUBLE) AS oldbalanceDest,
        hgb_fraud_score, risk_tier, risk_tier AS priority_band, high_value_200k_flag, isFlaggedFraud, isFraud
        FROM x WHERE operational_alert = 1""",
    ),
    (
        "f",
        """SELECT transaction_id, CAST(step AS SMALLINT) AS step, transaction_day,
        CAST(hour_of_day AS SMALLINT) AS hour_of_day, type AS transaction_type, amount,
        nameOrig AS origin_account, nameDest AS destination_account, oldbalanceOrg AS oldbalance_org,
        oldbalanceDest AS oldbalance_dest, CAST(high_value_200k_flag AS SMALLINT) AS high_value_200k_flag,
        hgb_fraud_score, risk_tier, CAST(operational_alert AS SMALLINT) AS operational_alert,
        CAST(isFlaggedFraud AS SMALLINT) AS legacy_rule_flag, CAST(isFraud AS SMALLINT) AS actual_fraud FROM x""",
    ),
]
_TIERS = "(VALUES (1, 'Critical'), (2, 'High'), (3, 'Medium'), (4, 'Low')) AS tiers(tier_order, tier)"


def _metrics(curve: str, threshold: str, model: str) -> str:
    """The 17 fields of a scored model from its curve."""
    return f"""SELECT '{model}' AS Model, t AS Threshold,
      auc / NULLIF(CAST(p AS DOUBLE) * CAST(rows - p AS DOUBLE), 0) AS ROC_AUC, ap / p AS Average_Precision,
      {div0('tp + tn', 'rows')} AS Accuracy, {div0('tp', 'tp + fp')} AS Precision, {div0('tp', 'tp + fn')} AS Recall,
      {div0('2 * tp', '2 * tp + fp + fn')} AS F1, {div0('5 * tp', '5 * tp + 4 * fn + fp')} AS F2,
      {div0('tn', 'tn + fp')} AS Specificity, tn AS True_Negative, fp AS False_Positive, fn AS False_Negative,
      tp AS True_Positive, tp + fp AS Alerts, {pct0('tp + fp', 'rows')} AS Alert_Rate_Pct,
      {pct0('fp', 'fp + tn')} AS False_Positive_Rate_Pct
    FROM (SELECT ({threshold}) AS t, {big('MAX(alerts)')} AS rows, {big('MAX(tp)')} AS p,
      SUM(CAST(n - pos AS DOUBLE) * (tp - CAST(pos AS DOUBLE) / 2)) AS auc,
      SUM(pos * (CAST(tp AS DOUBLE) / alerts)) AS ap,
      {big(f'COALESCE(SUM(pos) FILTER (WHERE score >= ({threshold})), 0)')} AS tp,
      {big(f'COALESCE(SUM(n - pos) FILTER (WHERE score >= ({threshold})), 0)')} AS fp,
      {big(f'COALESCE(SUM(n - pos) FILTER (WHERE score < ({threshold})), 0)')} AS tn,
      {big(f'COALESCE(SUM(pos) FILTER (WHERE score < ({threshold})), 0)')} AS fn FROM {curve})"""


_RULE = f"""SELECT '{RULE}' AS Model, CAST(NULL AS DOUBLE) AS Threshold, CAST(NULL AS DOUBLE) AS ROC_AUC,
      CAST(NULL AS DOUBLE) AS Average_Precision, {div0('tp + tn', 'tp + tn + fp + fn')} AS Accuracy,
      {div0('tp', 'tp + fp')} AS Precision, {div0('tp', 'tp + fn')} AS Recall,
      {div0('2 * tp', '2 * tp + fp + fn')} AS F1, {div0('5 * tp', '5 * tp + 4 * fn + fp')} AS F2,
      {div0('tn', 'tn + fp')} AS Specificity, tn AS True_Negative, fp AS False_Positive, fn AS False_Negative,
      tp AS True_Positive, tp + fp AS Alerts, {pct0('tp + fp', 'tp + tn + fp + fn')} AS Alert_Rate_Pct,
      {pct0('fp', 'fp + tn')} AS False_Positive_Rate_Pct
    FROM (SELECT {cnt('isFraud = 1 AND isFlaggedFraud = 1')} AS tp, {cnt('isFraud = 0 AND isFlaggedFraud = 1')} AS fp,
      {cnt('isFraud = 0 AND isFlaggedFraud = 0')} AS tn, {cnt('isFraud = 1 AND isFlaggedFraud = 0')} AS fn FROM te)"""

_FRACTIONS = ["Threshold", "ROC_AUC", "Average_Precision", "Accuracy", "Precision", "Recall", "F1", "F2",
              "Specificity", "Alert_Rate_Pct", "False_Positive_Rate_Pct"]
_COUNTS = ["True_Negative", "False_Positive", "False_Negative", "True_Positive", "Alerts"]


def _rounded(fields: list[str]) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in fields)


def _metric_select(source: str, specificity: bool = True) -> str:
    fractions = [c for c in _FRACTIONS if specificity or c != "Specificity"]
    return f"SELECT Model, {_rounded(fractions)}, {', '.join(_COUNTS)} FROM ({source})"


_COMPARISON = " UNION ALL ".join(
    [
        _metrics("tc_c", "SELECT Threshold FROM best_c", CHAMPION),
        _metrics("tc_lb", "SELECT Threshold FROM best_lb", CHALLENGER),
        _RULE,
    ]
)
_STRESS = " UNION ALL ".join(
    _metrics(f"tc_{k}", f"SELECT Threshold FROM best_{k}", m) for k, m in _MODELS.items() if k != "c"
)

_BLOCKS += [
    ("sm", f"SELECT {', '.join(S.SOURCE_COLUMNS)} FROM t ORDER BY transaction_id LIMIT 100000"),
    ("ma", _metrics("tc_c", "SELECT Threshold FROM best_c", CHAMPION)),
    ("mb", _metrics("tc_lb", "SELECT Threshold FROM best_lb", CHALLENGER)),
]
# Newton steps: ``nx`` standardised rows, ``nr`` training rows with weights, ``ni``
# the coefficients after n steps, ``ns`` scores. A step sums the Hessian beside
# the gradient and eliminates column by column.
_STEPS = 14


def _newton(key: str, continuous: list[str], binary: list[str]) -> list[tuple[str, str]]:
    k = len(continuous) + len(binary) + 1
    x = ", ".join([f"({c} - {c}_m) / {c}_s" for c in continuous] + [d(c) for c in binary] + [d("1")])
    cell = lambda i, j: f"SUM(w * p * (1 - p) * x[{min(i, j)}] * x[{max(i, j)}])" + (" + 1" if i == j < k else "")
    slope = lambda i: f"SUM(w * (p - y) * x[{i}])" + (f" + b[{i}]" if i < k else "")
    rows = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(1, k + 1)), slope(i)]) + "]" for i in range(1, k + 1))
    turns = ", ".join(f"[[{d(str(i))}]]" for i in range(1, k + 1))
    q = "CAST(q[1][1] AS INTEGER)"
    solved = f"""list_reduce([a, {turns}], lambda a, q: list_transform(a, lambda row, i: CASE WHEN i = {q} THEN list_transform(row, lambda v: v / row[i])
      ELSE list_transform(row, lambda v, j: v - row[{q}] / a[{q}][{q}] * a[{q}][j]) END))"""
    return [
        (f"nx_{key}", f"SELECT transaction_id, step, isFraud, [{x}] AS x FROM g, mo"),
        (f"nr_{key}", f"""SELECT isFraud AS y, {d('COUNT(*) OVER ()')} / (2 * COUNT(*) OVER (PARTITION BY isFraud)) AS w, x
          FROM nx_{key} WHERE step <= (SELECT train_end FROM sb)"""),
        (f"ni_{key}", f"""SELECT 0 AS n, list_resize(CAST([] AS DOUBLE[]), {k}, {d('0')}) AS b UNION ALL
          SELECT n + 1, list_transform(s, lambda row, i: b[i] - row[{k + 1}]) FROM (SELECT n, b, {solved} AS s FROM (SELECT n, b, [{rows}] AS a
            FROM (SELECT n, b, x, y, w, 1 / (1 + exp(-list_dot_product(b, x))) AS p FROM ni_{key}, nr_{key} WHERE n < {_STEPS}) GROUP BY n, b))"""),
        (f"ns_{key}", f"""SELECT transaction_id, step, isFraud, 1 / (1 + exp(-list_dot_product((SELECT b FROM ni_{key} WHERE n = {_STEPS}), x))) AS sc
          FROM nx_{key} WHERE step > (SELECT train_end FROM sb)"""),
    ]


_SETS = dict(zip("abcd", S.FEATURE_SETS.items()))
_BLOCKS.append(
    ("mo", "SELECT " + ", ".join(f"AVG({c}) AS {c}_m, COALESCE(NULLIF(stddev_pop({c}), 0), 1) AS {c}_s" for c in S.CONTINUOUS_FEATURES)
        + " FROM g WHERE step <= (SELECT train_end FROM sb)")
)
for _k, (_, (_continuous, _binary, _)) in _SETS.items():
    _BLOCKS += [
        *_newton(_k, _continuous, _binary),
        (f"nv_{_k}", f"SELECT * FROM ns_{_k} WHERE step <= (SELECT validation_end FROM sb)"),
        (f"nte_{_k}", f"SELECT * FROM ns_{_k} WHERE step > (SELECT validation_end FROM sb)"),
        (f"nvc_{_k}", _curve(f"nv_{_k}", "sc")),
        (f"nbest_{_k}", f"SELECT Threshold, Precision, Recall, F2 FROM ({_pr(f'nvc_{_k}')}) ORDER BY F2 DESC, Threshold LIMIT 1"),
        (f"ntc_{_k}", _curve(f"nte_{_k}", "sc")),
    ]
_LABELS = [f"continuous__{c}" for c in S.CONTINUOUS_FEATURES] + [f"binary__{c}" for c in S.BASELINE_BINARY]
_REGRESSIONS = " UNION ALL ".join(
    f"""SELECT m.Model, CAST({len(a) + len(b)} AS INTEGER) AS Feature_Count, {r('m.Threshold')} AS Validation_Threshold, {r('b.Precision')} AS Validation_Precision,
      {r('b.Recall')} AS Validation_Recall, {r('b.F2')} AS Validation_F2,
      {', '.join(f"{r('m.' + c)} AS {c}" for c in _FRACTIONS if c not in ('Threshold', 'Specificity'))}, {', '.join(f'm.{c}' for c in _COUNTS)}
      FROM ({_metrics(f'ntc_{k}', f'SELECT Threshold FROM nbest_{k}', name)}) m, nbest_{k} b"""
    for k, (name, (a, b, _)) in _SETS.items()
)

# The first split of the first tree: bins by shares of rows, gradient w (1/2 - y), Hessian w / 4.
_TREE_SIDE = "pow({0}, 2) / ({1} + 1)"
_BLOCKS += [
    ("bv", " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS feature, {d(c)} AS value, isFraud AS y FROM g WHERE step <= (SELECT train_end FROM sb)"
        for i, c in enumerate(S.CHAMPION_FEATURES))),
    ("bw", """SELECT y, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (2 * COUNT(*)) AS w FROM bv WHERE place = 0 GROUP BY y"""),
    ("bp", """SELECT feature, value, COUNT(*) AS n, SUM(w * (0.5 - y)) AS g, SUM(w / 4) AS h FROM bv JOIN bw USING (y) GROUP BY feature, value"""),
    ("bc", """SELECT *, SUM(n) OVER (PARTITION BY feature ORDER BY value) AS upto, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) AS number,
        COUNT(*) OVER (PARTITION BY feature) AS different, SUM(n) OVER (PARTITION BY feature) AS rows FROM bp"""),
    ("bb", """SELECT feature, CASE WHEN different <= 255 THEN number - 1 ELSE (upto - n) * 255 // rows END AS bin, MIN(value) AS low, MAX(value) AS high,
        SUM(n) AS n, SUM(g) AS g, SUM(h) AS h FROM bc GROUP BY 1, 2"""),
    ("bs", """SELECT feature, bin, (high + LEAD(low) OVER (PARTITION BY feature ORDER BY bin)) / 2 AS edge,
        SUM(n) OVER l AS nl, SUM(g) OVER l AS gl, SUM(h) OVER l AS hl, SUM(n) OVER a AS na, SUM(g) OVER a AS ga, SUM(h) OVER a AS ha
        FROM bb WINDOW l AS (PARTITION BY feature ORDER BY bin), a AS (PARTITION BY feature)"""),
    ("bg", f"""SELECT feature, bin, edge, {_TREE_SIDE.format('gl', 'hl')} + {_TREE_SIDE.format('ga - gl', 'ha - hl')} - {_TREE_SIDE.format('ga', 'ha')} AS gain
        FROM bs WHERE nl >= 100 AND na - nl >= 100"""),
]

_PAIR = ["ROC_AUC", "Average_Precision", "Precision", "Recall", "F1", "F2", "True_Positive", "False_Positive",
         "False_Negative", "Alerts", "Alert_Rate_Pct"]

_GROUP = f"""{big('COUNT(*)')} AS Transaction_Count, {d('COALESCE(SUM(amount), 0)')} AS Transaction_Value,
  {cnt('isFraud = 1')} AS Fraud_Count, {d('COALESCE(SUM(amount) FILTER (WHERE isFraud = 1), 0)')} AS Fraud_Value"""

_BAND = """CASE WHEN amount < -0.001 THEN NULL WHEN amount <= 0 THEN '0' WHEN amount <= 10000 THEN '0-10K'
  WHEN amount <= 50000 THEN '10K-50K' WHEN amount <= 100000 THEN '50K-100K' WHEN amount <= 200000 THEN '100K-200K'
  WHEN amount <= 500000 THEN '200K-500K' WHEN amount <= 1000000 THEN '500K-1M' WHEN amount <= 5000000 THEN '1M-5M'
  ELSE '>5M' END"""
_BANDS = "(VALUES ('0'), ('0-10K'), ('10K-50K'), ('50K-100K'), ('100K-200K'), ('200K-500K'), ('500K-1M'), ('1M-5M'), ('>5M')) AS bands(band)"


def _by(source: str, key: str, name: str) -> str:
    return (
        f"SELECT {name}, Transaction_Count, Transaction_Value, Fraud_Count, Fraud_Value, "
        f"{r(pct0('Fraud_Count', 'Transaction_Count'))} AS Fraud_Rate_Pct FROM (SELECT {key} AS {name}, {_GROUP} FROM {source} "
        f"WHERE {key} IS NOT NULL GROUP BY 1)"
    )


def _lift(source: str, key: str, true_rate: str, false_rate: str) -> str:
    parts = []
    for flag in S.RISK_FLAGS:
        n, n0 = cnt(f"{flag} = 1"), cnt(f"{flag} <> 1")
        f1, f0 = cnt(f"{flag} = 1 AND isFraud = 1"), cnt(f"{flag} <> 1 AND isFraud = 1")
        parts.append(
            f"SELECT '{flag}' AS {key}, {n} AS n, {f1} AS f1, {n0} AS n0, {f0} AS f0 FROM {source}"
        )
    rate, rate0 = pct0("f1", "n"), pct0("f0", "n0")
    return (
        f"SELECT {key}, n AS Flag_True_Count, f1 AS Fraud_When_True, {r(rate)} AS {true_rate}, "
        f"n0 AS Flag_False_Count, f0 AS Fraud_When_False, {r(rate0)} AS {false_rate}, "
        f"{r(f'{rate} / NULLIF({rate0}, 0)')} AS Fraud_Rate_Lift FROM ({' UNION ALL '.join(parts)})"
    )


_MONEY = S.MONEY_COLUMNS
_SOURCE_ROWS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _MONEY else c for c in S.SOURCE_COLUMNS)
_MASTER_ROWS = "transaction_id, step, type, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY) + (
    ", nameOrig, nameDest, isFraud, isFlaggedFraud, transaction_day, hour_of_day, round(log_amount, 6) AS log_amount, "
    + ", ".join(S.RISK_FLAGS)
    + ", round(amount_to_origin_balance_ratio, 6) AS amount_to_origin_balance_ratio"
    ", round(amount_to_destination_balance_ratio, 6) AS amount_to_destination_balance_ratio"
    ", origin_balance_error_abs, origin_balance_mismatch_flag"
)
_POPULATION_ROWS = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c in _MONEY
    else f"round({c}, 6) AS {c}" if c == "log_amount" or c.endswith("_ratio") else c
    for c in S.MODEL_COLUMNS
)
_QUEUE_ROWS = ", ".join(
    c for c in ["investigation_rank", "transaction_id", "step", "transaction_day", "hour_of_day", "type", "amount",
                "nameOrig", "nameDest", "oldbalanceOrg", "oldbalanceDest", "hgb_fraud_score", "risk_tier",
                "priority_band", "high_value_200k_flag", "isFlaggedFraud"]
)
_FACT_ROWS = """transaction_id, step, transaction_day, hour_of_day, transaction_type, CAST(amount AS DOUBLE) AS amount,
  origin_account, destination_account, CAST(oldbalance_org AS DOUBLE) AS oldbalance_org,
  CAST(oldbalance_dest AS DOUBLE) AS oldbalance_dest, high_value_200k_flag, hgb_fraud_score, risk_tier,
  operational_alert, legacy_rule_flag, actual_fraud"""
_QUEUE_TABLE = """CAST(investigation_rank AS BIGINT) AS investigation_rank, transaction_id, CAST(step AS SMALLINT) AS step,
  transaction_day, CAST(hour_of_day AS SMALLINT) AS hour_of_day, type AS transaction_type, amount,
  nameOrig AS origin_account, nameDest AS destination_account, oldbalanceOrg AS oldbalance_org,
  oldbalanceDest AS oldbalance_dest, hgb_fraud_score, risk_tier, priority_band,
  CAST(high_value_200k_flag AS SMALLINT) AS high_value_200k_flag, CAST(isFlaggedFraud AS SMALLINT) AS legacy_rule_flag"""
_VIEW_QUEUE = """CAST(investigation_rank AS BIGINT) AS investigation_rank, transaction_id, CAST(step AS SMALLINT) AS step,
  transaction_day, CAST(hour_of_day AS SMALLINT) AS hour_of_day, type AS transaction_type, amount,
  nameOrig AS origin_account, nameDest AS destination_account, oldbalanceOrg AS oldbalance_org,
  oldbalanceDest AS oldbalance_dest, round(hgb_fraud_score, 6) AS fraud_risk_score, risk_tier, priority_band,
  CAST(high_value_200k_flag AS SMALLINT) AS high_value_200k_flag, CAST(isFlaggedFraud AS SMALLINT) AS legacy_rule_flag,
  CASE WHEN hgb_fraud_score >= 0.99 THEN 'Immediate Review' WHEN hgb_fraud_score >= 0.98 THEN 'Urgent Review'
    ELSE 'Priority Review' END AS recommended_action"""

_TIER_SUMMARY = f"""SELECT tier AS Risk_Tier, n AS Transaction_Count, {r(pct0('n', 'SUM(n) OVER ()'))} AS Population_Pct,
  {r('score / NULLIF(n, 0)')} AS Average_Model_Score, {d('value')} AS Transaction_Value, fraud AS Fraud_Count,
  {r(pct0('fraud', 'n'))} AS Fraud_Rate_Pct, {r(pct0('fraud', 'SUM(fraud) OVER ()'))} AS Fraud_Capture_Pct,
  {d('fraud_value')} AS Fraud_Value, {r(pct0('fraud_value', 'SUM(fraud_value) OVER ()'))} AS Fraud_Value_Capture_Pct,
  alerts AS Operational_Alerts
  FROM (SELECT tier, {big('COUNT(transaction_id)')} AS n, SUM(hgb_fraud_score) AS score, COALESCE(SUM(amount), 0) AS value,
    {cnt('isFraud = 1')} AS fraud, COALESCE(SUM(amount) FILTER (WHERE isFraud = 1), 0) AS fraud_value,
    {cnt('operational_alert = 1')} AS alerts FROM {_TIERS} LEFT JOIN x ON risk_tier = tier GROUP BY tier)"""

# Scores have four decimals, so their mean is rounded exactly on integers: a float
# mean may fall on either side of a tie.
_MEAN_SCORE = half_up("points", "transaction_count * 10000", 6)
_FACT_GROUP = f"""{big('COUNT(*)')} AS transaction_count, SUM(amount) AS value, {big('SUM(actual_fraud)')} AS fraud_count,
  COALESCE(SUM(amount) FILTER (WHERE actual_fraud = 1), 0) AS fraud_amount, {big('SUM(operational_alert)')} AS operational_alerts,
  SUM(CAST(round(hgb_fraud_score * 10000) AS BIGINT)) AS points"""


def _time_view(key: str) -> str:
    return f"""SELECT {key}, transaction_count, {d('value')} AS transaction_value, fraud_count,
      {d('fraud_amount')} AS fraud_value, {rpct('fraud_count', 'transaction_count', 4)} AS fraud_rate_pct,
      operational_alerts, {_MEAN_SCORE} AS average_model_score
      FROM (SELECT {key}, {_FACT_GROUP} FROM f GROUP BY 1)"""


_TIER_VIEW = f"""SELECT risk_tier, CASE risk_tier WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3
    WHEN 'Low' THEN 4 END AS risk_tier_sort, transaction_count,
  {rpct('transaction_count', 'SUM(transaction_count) OVER ()', 4)} AS population_pct, {_MEAN_SCORE} AS average_model_score,
  {d('value')} AS transaction_value, fraud_count, {rpct('fraud_count', 'transaction_count', 4)} AS fraud_rate_pct,
  {rpct('fraud_count', 'SUM(fraud_count) OVER ()', 4)} AS fraud_capture_pct, {d('fraud_amount')} AS fraud_value,
  {rpct('fraud_amount * 100', 'SUM(fraud_amount) OVER () * 100', 4)} AS fraud_value_capture_pct, operational_alerts
  FROM (SELECT risk_tier, {_FACT_GROUP} FROM f GROUP BY 1)"""
_TYPE_VIEW = f"""SELECT transaction_type, transaction_count, {d('value')} AS transaction_value,
  {half_up('value * 100', 'transaction_count * 100', 2)} AS average_transaction_amount, fraud_count,
  {d('fraud_amount')} AS fraud_value, {rpct('fraud_count', 'transaction_count', 4)} AS fraud_rate_pct,
  {rpct('fraud_count', 'SUM(fraud_count) OVER ()', 4)} AS fraud_capture_pct, operational_alerts,
  {rpct('operational_alerts', 'transaction_count', 4)} AS alert_rate_pct, {_MEAN_SCORE} AS average_model_score
  FROM (SELECT transaction_type, {_FACT_GROUP} FROM f GROUP BY 1)"""

_ASSOCIATION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, isFraud)) AS importance_mean, stddev_pop({c}) AS importance_std FROM g"
    for c in S.CHAMPION_FEATURES
)
_COEFFICIENTS = " UNION ALL ".join(
    f"SELECT '{model}' AS model, '{c}' AS feature, corr({c}, isFraud) AS coefficient FROM g WHERE {where}"
    for (model, (continuous, binary, _)), where in zip(
        S.FEATURE_SETS.items(),
        [
            "step <= (SELECT train_end FROM sb)",
            "step > (SELECT train_end FROM sb) AND step <= (SELECT validation_end FROM sb)",
            "step > (SELECT validation_end FROM sb)",
            "TRUE",
        ],
    )
    for c in continuous + binary
)
_PIVOT = ", ".join(
    f"{r(f'''MAX(coefficient) FILTER (WHERE model = '{m}')''')} AS {m}" for m in S.FEATURE_SETS
)

_SPLIT_CASE = """CASE WHEN step <= (SELECT train_end FROM sb) THEN 'TRAIN'
  WHEN step <= (SELECT validation_end FROM sb) THEN 'VALIDATION' ELSE 'TEST' END"""
_SPLIT_SUMMARY = f"""SELECT split, n AS Rows, {r(pct0('n', 'SUM(n) OVER ()'))} AS Population_Pct, fr AS Fraud_Count,
  {r(pct0('fr', 'n'))} AS Fraud_Rate_Pct, lo AS Minimum_Step, hi AS Maximum_Step
  FROM (SELECT {_SPLIT_CASE} AS split, {big('COUNT(*)')} AS n, {big('SUM(isFraud)')} AS fr, MIN(step) AS lo, MAX(step) AS hi FROM h GROUP BY 1)"""

_BLANK = "({0} IS NULL OR regexp_full_match({0}, '\\s*'))"
_BAD_STEP = "(step IS NULL OR step < 1 OR step > 743)"
_BAD_TYPE = "(type IS NULL OR type NOT IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER'))"
_BAD_LABEL = "({0} IS NULL OR {0} NOT IN (0, 1))"
_NON_FINITE = "({0} IS NULL OR isnan(CAST({0} AS DOUBLE)) OR isinf(CAST({0} AS DOUBLE)))"
_OUT = "type IN ('CASH_OUT', 'TRANSFER', 'PAYMENT', 'DEBIT')"


def _confusion(prefix: str, flag: str) -> str:
    return (
        f"{cnt(f'isFraud = 1 AND {flag} = 1')} AS {prefix}_tp, {cnt(f'isFraud = 0 AND {flag} = 1')} AS {prefix}_fp, "
        f"{cnt(f'isFraud = 1 AND {flag} = 0')} AS {prefix}_fn"
    )


_MISSING_D = [
    ("amount", "amount IS NULL OR isnan(amount)") if c == "amount" else (c, f"{c} IS NULL") for c in S.SOURCE_COLUMNS
]
_CAP_LEVELS = "(SELECT DISTINCT lv FROM (SELECT UNNEST([100, 250, 500, 1000, 2000]) AS lv UNION ALL SELECT COUNT(*) FROM q))"
_CAPACITY = f"""SELECT {big('lv')} AS Investigation_Capacity, n AS Alerts_Reviewed, fr AS Fraud_Found,
  {r(pct0('fr', 'n'))} AS Precision_Pct, {r(pct0('fr', '(SELECT SUM(isFraud) FROM x)'))} AS Total_Test_Fraud_Captured_Pct
  FROM (SELECT lv, {big('COUNT(investigation_rank)')} AS n, {cnt('isFraud = 1')} AS fr
    FROM {_CAP_LEVELS} LEFT JOIN q ON investigation_rank <= lv GROUP BY lv)"""

_REPORT_COUNTS = [
    ("fact_scored_transactions", "SELECT COUNT(*) FROM f"),
    ("investigator_alert_queue", "SELECT COUNT(*) FROM q"),
    ("risk_tier_thresholds", "SELECT 4"),
    ("risk_tier_summary", "SELECT 4"),
    ("operational_alert_summary", "SELECT 19"),
    ("investigation_capacity_summary", f"SELECT COUNT(*) FROM {_CAP_LEVELS}"),
    ("model_comparison", "SELECT 3"),
    ("hgb_feature_importance", "SELECT 7"),
]
_VIEW_COUNTS = [
    ("vw_executive_fraud_kpis", "SELECT 1"),
    ("vw_risk_tier_analysis", "SELECT COUNT(DISTINCT risk_tier) FROM f"),
    ("vw_transaction_type_risk", "SELECT COUNT(DISTINCT transaction_type) FROM f"),
    ("vw_daily_fraud_trend", "SELECT COUNT(DISTINCT transaction_day) FROM f"),
    ("vw_hourly_fraud_pattern", "SELECT COUNT(DISTINCT hour_of_day) FROM f"),
    ("vw_confusion_matrix", "SELECT 4"),
    ("vw_model_performance", "SELECT 3"),
    ("vw_investigation_capacity", f"SELECT COUNT(*) FROM {_CAP_LEVELS}"),
    ("vw_investigator_queue", "SELECT COUNT(*) FROM q"),
    ("vw_feature_importance", "SELECT 7"),
]


def _counts(pairs: list[tuple[str, str]], key: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {key}, {big(f'({q})')} AS row_count" for n, q in pairs)


def _master_column(column: str, expression: str | None = None) -> str:
    return f"SELECT transaction_id, {expression or column} AS {column} FROM m"


_VALUE_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS val, COUNT(*) AS n FROM h GROUP BY {c}"
    for c in ["type"] + S.RISK_FLAGS
)
_FORMAT = "format('{{:,}}', {0})"

_REASONS = f"""concat_ws('+', CASE WHEN amount < 0 THEN 'negative_amount' END, CASE WHEN {_BAD_TYPE} THEN 'invalid_type' END,
  CASE WHEN {_BAD_STEP} THEN 'invalid_step' END, CASE WHEN {_BAD_LABEL.format('isFraud')} THEN 'invalid_label' END,
  CASE WHEN {_BAD_LABEL.format('isFlaggedFraud')} THEN 'invalid_existing_flag' END,
  CASE WHEN {_BLANK.format('nameOrig')} OR {_BLANK.format('nameDest')} THEN 'blank_account' END)"""

# ---- one body per query ----------------------------------------------------
def _rules(table: str, key: str) -> list[tuple[str, str]]:
    """Key, filled columns, flags and value lists of a table."""
    columns = re.findall(r"(\w+) [A-Z]+[^,]*?(?:\(20,2\))? NOT NULL", TABLE_COLUMNS[table])
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return [
        (f"unique:{key}", big(f"COUNT(*) - COUNT(DISTINCT {key})")),
        *((f"not_null:{c}", cnt(f"{c} IS NULL")) for c in columns),
        *((f"flag:{c}", cnt(f"{c} NOT IN (0, 1)")) for c in TABLE_FLAGS[table]),
        *((f"domain:{c}", cnt(f"{c} NOT IN ({listed(v)})")) for c, v in TABLE_DOMAINS[table].items()),
    ]


_BLOCKS.append(("qt", f"SELECT {_QUEUE_TABLE} FROM q"))
BODIES: dict[str, str] = {
    "src_csv_sample": f"SELECT {_SOURCE_ROWS} FROM t ORDER BY transaction_id LIMIT 100000",
    "src_csv_full": f"SELECT {_SOURCE_ROWS} FROM t",
    "src_line_count": "SELECT COUNT(*) AS total_rows FROM t",
    "src_parquet_projected": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders",
    "src_parquet_rowcount": "SELECT COUNT(*) AS row_count FROM orders",
    "src_head": """SELECT transaction_id, step, transaction_day, hour_of_day, type, CAST(amount AS DOUBLE) AS amount,
      round(log_amount, 6) AS log_amount, zero_amount_flag, high_value_200k_flag, destination_is_merchant, isFraud
      FROM m ORDER BY transaction_id LIMIT 5""",
    "src_stage_output": f"SELECT split AS Split, Rows, Maximum_Step FROM ({_SPLIT_SUMMARY}) WHERE split = 'VALIDATION'",
    "sink_parquet": f"SELECT COUNT(*) AS row_count, {big('SUM(transaction_id)')} AS id_sum, {d('SUM(amount)')} AS amount_sum FROM m",
    "sink_overwrite": f"SELECT COUNT(*) AS row_count, {big('SUM(transaction_id)')} AS id_sum, {d('SUM(amount)')} AS amount_sum FROM h",
    "sink_table_copy": "SELECT transaction_id, step, type AS transaction_type, CAST(amount AS DOUBLE) AS amount, isFlaggedFraud AS legacy_rule_flag FROM t",
    "sink_truncate_reload": _counts(_REPORT_COUNTS, "table_name"),
    "sink_fact_load": f"SELECT {_FACT_ROWS} FROM f",
    "sink_queue_load": f"SELECT {_QUEUE_TABLE} FROM q",
    "sink_small_table": f"""SELECT Risk_Tier AS risk_tier, Transaction_Count AS transaction_count, Population_Pct AS population_pct,
      Average_Model_Score AS average_model_score, Transaction_Value AS transaction_value, Fraud_Count AS fraud_count,
      Fraud_Rate_Pct AS fraud_rate_pct, Fraud_Capture_Pct AS fraud_capture_pct, Fraud_Value AS fraud_value,
      Fraud_Value_Capture_Pct AS fraud_value_capture_pct, Operational_Alerts AS operational_alerts FROM ({_TIER_SUMMARY})""",
    "f_transaction_id": "SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS transaction_id, o_orderkey FROM orders",
    "f_transaction_day": _master_column("transaction_day"),
    "f_hour_of_day": _master_column("hour_of_day"),
    "f_log_amount": _master_column("log_amount", "round(log_amount, 6)"),
    "f_zero_amount_flag": _master_column("zero_amount_flag"),
    "f_high_value_flag": _master_column("high_value_200k_flag"),
    "f_origin_zero_flag": _master_column("origin_zero_before_flag"),
    "f_dest_zero_flag": _master_column("destination_zero_before_flag"),
    "f_amount_exceeds_flag": _master_column("amount_exceeds_origin_balance_flag"),
    "f_dest_merchant": _master_column("destination_is_merchant"),
    "f_ratio_origin": _master_column("amount_to_origin_balance_ratio", "round(amount_to_origin_balance_ratio, 6)"),
    "f_ratio_dest": _master_column("amount_to_destination_balance_ratio", "round(amount_to_destination_balance_ratio, 6)"),
    "f_balance_error": _master_column("origin_balance_error_abs"),
    "f_balance_mismatch": _master_column("origin_balance_mismatch_flag"),
    "f_narrow_types": "SELECT transaction_id, isFraud, isFlaggedFraud FROM m",
    "p_master": f"SELECT {_MASTER_ROWS} FROM m",
    "p_model_columns": f"SELECT {_POPULATION_ROWS} FROM h",
    "f_type_transfer": "SELECT transaction_id, type_transfer_flag FROM g",
    "f_log_balances": "SELECT transaction_id, round(log_oldbalanceOrg, 4) AS log_oldbalanceOrg, round(log_oldbalanceDest, 4) AS log_oldbalanceDest FROM g",
    "f_hour_cyclic": "SELECT transaction_id, round(hour_sin, 4) + 0 AS hour_sin, round(hour_cos, 4) + 0 AS hour_cos FROM g",
    "p_model_features": """SELECT transaction_id, step, round(log_amount, 4) AS log_amount, round(log_oldbalanceOrg, 4) AS log_oldbalanceOrg,
      round(log_oldbalanceDest, 4) AS log_oldbalanceDest, round(hour_sin, 4) + 0 AS hour_sin, round(hour_cos, 4) + 0 AS hour_cos,
      type_transfer_flag, high_value_200k_flag, origin_zero_before_flag, destination_zero_before_flag, zero_amount_flag,
      amount_exceeds_origin_balance_flag, isFraud FROM g""",
    "f_amount_band": f"SELECT transaction_id, {_BAND} AS amount_band FROM t",
    "f_id_prefix": "SELECT transaction_id, substr(nameOrig, 1, 1) AS origin_prefix, substr(nameDest, 1, 1) AS destination_prefix FROM t",
    "f_risk_tier": "SELECT transaction_id, risk_tier FROM x",
    "f_operational_alert": "SELECT transaction_id, operational_alert FROM x",
    "f_predictions": """SELECT transaction_id, step, isFraud, round(score_c, 6) AS hgb_fraud_score, round(score_lb, 6) AS logistic_model_b_score,
      CAST(score_c >= (SELECT Threshold FROM best_c) AS TINYINT) AS hgb_predicted_fraud,
      CAST(score_lb >= (SELECT Threshold FROM best_lb) AS TINYINT) AS logistic_model_b_predicted,
      CAST(score_c >= 0.5 AS TINYINT) AS predicted_fraud_050 FROM te""",
    "f_priority_band": "SELECT investigation_rank, transaction_id, risk_tier, priority_band FROM q",
    "f_recommended_action": """SELECT transaction_id, CASE WHEN hgb_fraud_score >= 0.99 THEN 'Immediate Review'
      WHEN hgb_fraud_score >= 0.98 THEN 'Urgent Review' ELSE 'Priority Review' END AS recommended_action FROM q""",
    "f_tier_sort": """SELECT transaction_id, risk_tier, CASE risk_tier WHEN 'Critical' THEN 1 WHEN 'High' THEN 2
      WHEN 'Medium' THEN 3 ELSE 4 END AS risk_tier_sort FROM x""",
    "p_investigator": f"SELECT {_QUEUE_ROWS} FROM q",
    "flt_high_risk": "SELECT transaction_id, type, CAST(amount AS DOUBLE) AS amount FROM t WHERE type IN ('TRANSFER', 'CASH_OUT')",
    "flt_null_safe_masks": f"""SELECT {cnt('COALESCE(isFraud = 1, FALSE)')} AS fraud_rows, {cnt('NOT COALESCE(isFraud = 1, FALSE)')} AS other_rows,
      {cnt('COALESCE(isFlaggedFraud = 1, FALSE)')} AS flagged_rows, {cnt('NOT COALESCE(isFlaggedFraud = 1, FALSE)')} AS unflagged_rows FROM d""",
    "flt_blank_id": f"SELECT {cnt(_BLANK.format('nameOrig'))} AS blank_origin, {cnt(_BLANK.format('nameDest'))} AS blank_destination FROM d",
    "flt_domain": f"""SELECT {cnt(_BAD_STEP)} AS invalid_step, {cnt(_BAD_TYPE)} AS invalid_type,
      {cnt(_BAD_LABEL.format('isFraud'))} AS invalid_isfraud, {cnt(_BAD_LABEL.format('isFlaggedFraud'))} AS invalid_isflagged FROM d""",
    "flt_non_finite": f"SELECT nameDest, COUNT(*) AS non_finite_rows FROM d WHERE {_NON_FINITE.format('amount')} GROUP BY nameDest",
    "flt_split": f"SELECT transaction_id, step, {_SPLIT_CASE} AS split FROM h",
    "flt_scoring_period": """SELECT transaction_id, step, type, CAST(amount AS DOUBLE) AS amount FROM m WHERE type IN ('TRANSFER', 'CASH_OUT')
      AND step > (SELECT train_end FROM sb) AND step <= (SELECT validation_end FROM sb)""",
    "flt_alerts": "SELECT transaction_id, round(hgb_fraud_score, 6) AS hgb_fraud_score FROM x WHERE operational_alert = 1",
    "flt_model_row": f"""SELECT Model, {r('Threshold')} AS Threshold, True_Positive, Alerts FROM ({_COMPARISON})
      WHERE Model LIKE '%HistGradientBoosting%' OR Model = '{RULE}'""",
    "flt_lift_not_null": f"SELECT Risk_Flag, Fraud_Rate_Lift FROM ({_lift('m', 'Risk_Flag', 'a', 'b')}) WHERE Fraud_Rate_Lift IS NOT NULL",
    "j_partial_merge": f"SELECT type, {big('COUNT(*)')} AS row_count, {d('SUM(amount)')} AS value FROM t GROUP BY type",
    "j_type_align": f"SELECT type AS Transaction_Type, {_GROUP} FROM t GROUP BY type",
    "j_prefix_outer": f"""SELECT COALESCE(o.p, dd.p) AS Prefix, {big('COALESCE(o.n, 0)')} AS Origin_Count, {big('COALESCE(dd.n, 0)')} AS Destination_Count
      FROM (SELECT substr(nameOrig, 1, 1) AS p, COUNT(*) AS n FROM t GROUP BY 1) o
      FULL JOIN (SELECT substr(nameDest, 1, 1) AS p, COUNT(*) AS n FROM t GROUP BY 1) dd ON o.p = dd.p""",
    "j_type_left": f"""SELECT type AS Transaction_Type, COUNT(*) AS Total_Transactions, {cnt('amount > 200000')} AS Transactions_Above_200k,
      {cnt('amount > 200000 AND isFraud = 1')} AS Fraud_Above_200k FROM t GROUP BY type""",
    "j_band_dense": f"""SELECT band AS Amount_Bucket, {big('COUNT(transaction_id)')} AS Transaction_Count, {cnt('isFraud = 1')} AS Fraud_Count
      FROM {_BANDS} LEFT JOIN (SELECT *, {_BAND} AS bb FROM m) ON bb = band GROUP BY band""",
    "j_tier_dense": f"SELECT Risk_Tier, Transaction_Count, Average_Model_Score, Fraud_Rate_Pct FROM ({_TIER_SUMMARY})",
    "j_threshold_broadcast": "SELECT transaction_id, round(hgb_fraud_score, 6) AS hgb_fraud_score, risk_tier, operational_alert FROM x",
    "j_delta_baseline": f"""SELECT c.Model, {r('c.ROC_AUC - b.ROC_AUC')} AS ROC_AUC_Delta_vs_A,
      {r('c.Average_Precision - b.Average_Precision')} AS Average_Precision_Delta_vs_A, {r('c.Precision - b.Precision')} AS Precision_Delta_vs_A,
      {r('c.Recall - b.Recall')} AS Recall_Delta_vs_A, {r('c.F2 - b.F2')} AS F2_Delta_vs_A,
      {r('c.Alert_Rate_Pct - b.Alert_Rate_Pct')} AS Alert_Rate_Delta_vs_A, c.True_Positive - b.True_Positive AS True_Positive_Delta_vs_A,
      c.False_Positive - b.False_Positive AS False_Positive_Delta_vs_A
      FROM ({_STRESS}) c, (SELECT * FROM ({_STRESS}) WHERE Model = 'Model_A_Current_Baseline') b""",
    "j_delta_pair": " UNION ALL ".join(
        f"SELECT '{m}' AS Metric, {r(d('a.' + m))} AS HGB_Value, {r(d('b.' + m))} AS Model_B_Value, {r(d('a.' + m) + ' - ' + d('b.' + m))} AS HGB_Minus_Model_B FROM ma a, mb b"
        for m in _PAIR
    ),
    "q_sample_profile": f"""SELECT 'shape' AS Section, 'rows' AS Item, {big('COUNT(*)')} AS Value FROM sm UNION ALL SELECT 'shape', 'columns', 11
      UNION ALL {' UNION ALL '.join(f"SELECT 'missing', '{c}', {cnt(c + ' IS NULL')} FROM sm" for c in S.SOURCE_COLUMNS)}
      UNION ALL SELECT 'duplicates', 'rows', {big('(SELECT COUNT(*) FROM sm) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sm))')}
      UNION ALL SELECT 'type', type, COUNT(*) FROM sm GROUP BY type
      UNION ALL SELECT 'isFraud', CAST(isFraud AS VARCHAR), COUNT(*) FROM sm GROUP BY isFraud
      UNION ALL SELECT 'isFlaggedFraud', CAST(isFlaggedFraud AS VARCHAR), COUNT(*) FROM sm GROUP BY isFlaggedFraud""",
    "q_overall_profile": f"""SELECT Metric, {d('Value')} AS Value FROM ({longform([
        ("Total rows", d("COUNT(*)")), ("Total columns", d("MAX(11)")), ("Minimum step", d("MIN(step)")), ("Maximum step", d("MAX(step)")),
        ("Total transaction value", d("SUM(amount)")), ("Average transaction amount", r(div("SUM(amount)", "COUNT(*)"))),
        ("Minimum transaction amount", d("MIN(amount)")), ("Maximum transaction amount", d("MAX(amount)")),
        ("Fraud transactions", d("SUM(isFraud)")), ("Fraud rate (%)", r(pct0("SUM(isFraud)", "COUNT(*)"))),
        ("Fraud transaction value", d("SUM(amount) FILTER (WHERE isFraud = 1)")),
        ("Fraud value share (%)", r(pct0("SUM(amount) FILTER (WHERE isFraud = 1)", "SUM(amount)"))),
        ("Flagged transactions", d("SUM(isFlaggedFraud)")),
        ("Flag precision (%)", r(pct0(cnt("isFraud = 1 AND isFlaggedFraud = 1"), "SUM(isFlaggedFraud)"))),
        ("Flag recall (%)", r(pct0(cnt("isFraud = 1 AND isFlaggedFraud = 1"), "SUM(isFraud)"))),
        ("Unique origin accounts", d("COUNT(DISTINCT nameOrig)")), ("Unique destination accounts", d("COUNT(DISTINCT nameDest)")),
        ("Duplicate rows", d("COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * EXCLUDE (transaction_id) FROM t))")),
      ], "Metric", "Value", "t")})""",
    "q_missing": " UNION ALL ".join(
        f"SELECT '{c}' AS \"Column\", {cnt(w)} AS Missing_Count, {r(pct0(cnt(w), 'COUNT(*)'))} AS Missing_Percentage FROM d"
        for c, w in _MISSING_D
    ),
    "q_numeric_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"Column\", {d(f'MIN({c})')} AS Minimum, {d(f'MAX({c})')} AS Maximum, {r(div(f'SUM({c})', f'COUNT({c})'))} AS Mean, "
        f"{cnt(f'{c} = 0')} AS Zero_Count, {cnt(f'{c} < 0')} AS Negative_Count FROM t"
        for c in S.NUMERIC_COLUMNS
    ),
    "q_type_profile": f"""SELECT *, {r(pct0('Fraud_Count', 'Transaction_Count'))} AS Fraud_Rate_Pct,
      {r(pct0('Fraud_Value', 'Transaction_Value'))} AS Fraud_Value_Rate_Pct FROM (SELECT type AS Transaction_Type, {_GROUP} FROM t GROUP BY type)""",
    "q_rule_performance": longform([
        ("True Positive", d("tp")), ("False Positive", d("fp")), ("True Negative", d("tn")), ("False Negative", d("fn")),
        ("Precision (%)", r(pct0("tp", "tp + fp"))), ("Recall / Detection Rate (%)", r(pct0("tp", "tp + fn"))),
      ], "Metric", "Value", f"""(SELECT {cnt('isFraud = 1 AND isFlaggedFraud = 1')} AS tp, {cnt('isFraud = 0 AND isFlaggedFraud = 1')} AS fp,
        {cnt('isFraud = 0 AND isFlaggedFraud = 0')} AS tn, {cnt('isFraud = 1 AND isFlaggedFraud = 0')} AS fn FROM t)"""),
    "q_distinct_accounts": "SELECT COUNT(DISTINCT nameOrig) AS unique_origin_accounts, COUNT(DISTINCT nameDest) AS unique_destination_accounts FROM t",
    "q_duplicate_rows": f"SELECT {big('(SELECT COUNT(*) FROM d) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d))')} AS duplicate_rows",
    "q_dq_audit": longform([
        ("Total rows", big("COUNT(*)")), ("Zero transaction amounts", cnt("amount = 0")), ("Negative transaction amounts", cnt("amount < 0")),
        ("Zero-amount fraud transactions", cnt("amount = 0 AND isFraud = 1")), ("Zero-amount legitimate transactions", cnt("amount = 0 AND isFraud = 0")),
        ("Invalid step values", cnt(_BAD_STEP)), ("Invalid transaction types", cnt(_BAD_TYPE)),
        ("Invalid isFraud values", cnt(_BAD_LABEL.format("isFraud"))), ("Invalid isFlaggedFraud values", cnt(_BAD_LABEL.format("isFlaggedFraud"))),
        ("Blank origin IDs", cnt(_BLANK.format("nameOrig"))), ("Blank destination IDs", cnt(_BLANK.format("nameDest"))),
        ("Non-finite numeric values", " + ".join(cnt(_NON_FINITE.format(c)) for c in S.NUMERIC_COLUMNS)),
        ("Outgoing origin-balance mismatches", cnt(f"{_OUT} AND abs(oldbalanceOrg - newbalanceOrig - amount) > 0.01")),
        ("CASH_IN origin-balance mismatches", cnt("type = 'CASH_IN' AND abs(newbalanceOrig - oldbalanceOrg - amount) > 0.01")),
      ], '"Check"', '"Count"', "d"),
    "q_dq_zero_amount": f"""SELECT {cnt('amount = 0')} AS zero_amount_count, {cnt('amount < 0')} AS negative_amount_count,
      {cnt('amount = 0 AND isFraud = 1')} AS zero_amount_fraud, {cnt('amount = 0 AND isFraud = 0')} AS zero_amount_legitimate FROM d""",
    "q_dq_non_finite": f"SELECT {' + '.join(cnt(_NON_FINITE.format(c)) for c in S.NUMERIC_COLUMNS)} AS nonfinite_numeric_count FROM d",
    "q_balance_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"Column\", {cnt(f'{c} = 0')} AS Zero_Count, {r(pct0(cnt(f'{c} = 0'), 'COUNT(*)'))} AS Zero_Percentage, {cnt(f'{c} < 0')} AS Negative_Count FROM t"
        for c in S.BALANCE_COLUMNS
    ),
    "q_prefix_summary": f"""SELECT COALESCE(o.p, dd.p) AS Prefix, {big('COALESCE(o.n, 0)')} AS Origin_Count, {big('COALESCE(dd.n, 0)')} AS Destination_Count
      FROM (SELECT substr(nameOrig, 1, 1) AS p, COUNT(*) AS n FROM d GROUP BY 1) o
      FULL JOIN (SELECT substr(nameDest, 1, 1) AS p, COUNT(*) AS n FROM d GROUP BY 1) dd ON o.p IS NOT DISTINCT FROM dd.p""",
    "q_high_value_profile": f"""SELECT type AS Transaction_Type, COUNT(*) AS Total_Transactions, {cnt('amount > 200000')} AS Transactions_Above_200k,
      {cnt('amount > 200000 AND isFraud = 1')} AS Fraud_Above_200k FROM t GROUP BY type""",
    "q_balance_consistency": longform([
        ("Outgoing transactions checked", cnt(_OUT)),
        ("Outgoing origin-balance mismatches", cnt(f"{_OUT} AND abs(oldbalanceOrg - newbalanceOrig - amount) > 0.01")),
        ("CASH_IN transactions checked", cnt("type = 'CASH_IN'")),
        ("CASH_IN origin-balance mismatches", cnt("type = 'CASH_IN' AND abs(newbalanceOrig - oldbalanceOrg - amount) > 0.01")),
      ], '"Check"', '"Count"', "t"),
    "q_dataset_validation": longform([
        ("Source rows processed", d("COUNT(*)")), ("Master analytical rows", d("COUNT(*)")), ("Master Parquet rows", d("COUNT(*)")),
        ("Rows lost during processing", d("COUNT(*) - (SELECT COUNT(*) FROM t)")), ("Source fraud transactions", d("MAX((SELECT SUM(isFraud) FROM t))")),
        ("Master fraud transactions", d("SUM(isFraud)")), ("Full dataset fraud rate (%)", r(pct0("SUM(isFraud)", "COUNT(*)"))),
        ("High-risk modelling rows", d("MAX((SELECT COUNT(*) FROM h))")), ("High-risk Parquet rows", d("MAX((SELECT COUNT(*) FROM h))")),
        ("High-risk modelling fraud", d("MAX((SELECT SUM(isFraud) FROM h))")),
        ("High-risk fraud rate (%)", r(pct0("MAX((SELECT SUM(isFraud) FROM h))", "MAX((SELECT COUNT(*) FROM h))"))),
        ("Zero-amount transactions", d("SUM(zero_amount_flag)")), ("Zero-amount fraud transactions", d(cnt("zero_amount_flag = 1 AND isFraud = 1"))),
        ("Transactions above 200k", d("SUM(high_value_200k_flag)")),
      ], "Metric", "Value", "m"),
    "q_class_summary": f"""SELECT CASE isFraud WHEN 1 THEN 'Fraud' ELSE 'Legitimate' END AS Class, {big('COUNT(*)')} AS Transaction_Count,
      {d('SUM(amount)')} AS Transaction_Value, {r(div('SUM(amount)', 'COUNT(*)'))} AS Average_Amount, {d('MIN(amount)')} AS Minimum_Amount,
      {d('MAX(amount)')} AS Maximum_Amount, {r(div('SUM(oldbalanceOrg)', 'COUNT(*)'))} AS Average_Origin_Balance_Before,
      {r(div('SUM(oldbalanceDest)', 'COUNT(*)'))} AS Average_Destination_Balance_Before FROM m GROUP BY isFraud""",
    "q_type_summary": f"""SELECT Transaction_Type, Transaction_Count, Transaction_Value,
      {r(div0('Transaction_Value', 'Transaction_Count'))} AS Average_Transaction_Amount, Fraud_Count, Fraud_Value,
      {r(div0('Fraud_Value', 'Fraud_Count'))} AS Average_Fraud_Amount, {r(pct0('Fraud_Count', 'Transaction_Count'))} AS Fraud_Rate_Pct,
      {r(pct0('Fraud_Value', 'Transaction_Value'))} AS Fraud_Value_Share_Pct
      FROM (SELECT type AS Transaction_Type, {_GROUP} FROM m GROUP BY type)""",
    "q_hourly": _by("m", "hour_of_day", "Hour_of_Day"),
    "q_daily": _by("m", "transaction_day", "Transaction_Day"),
    "q_amount_band": f"""SELECT band AS Amount_Bucket, Transaction_Count, Transaction_Value, Fraud_Count, Fraud_Value,
      {r(pct0('Fraud_Count', 'Transaction_Count'))} AS Fraud_Rate_Pct
      FROM (SELECT band, {big('COUNT(transaction_id)')} AS Transaction_Count, {d('COALESCE(SUM(amount), 0)')} AS Transaction_Value,
        {cnt('isFraud = 1')} AS Fraud_Count, {d('COALESCE(SUM(amount) FILTER (WHERE isFraud = 1), 0)')} AS Fraud_Value
        FROM {_BANDS} LEFT JOIN (SELECT *, {_BAND} AS bb FROM m) ON bb = band GROUP BY band)""",
    "q_flag_lift": _lift("m", "Risk_Flag", "Fraud_Rate_When_True_Pct", "Fraud_Rate_When_False_Pct"),
    "q_population_summary": longform([
        ("Parquet rows", d("COUNT(*)")), ("Rows processed", d("COUNT(*)")), ("Total fraud", d("SUM(isFraud)")),
        ("Legitimate transactions", d("COUNT(*) - SUM(isFraud)")), ("Fraud rate (%)", r(pct0("SUM(isFraud)", "COUNT(*)"))),
        ("Minimum step", d("MIN(step)")), ("Maximum step", d("MAX(step)")),
      ], "Metric", "Value", "h"),
    "q_feature_missing": " UNION ALL ".join(
        f"SELECT '{c}' AS Feature, {cnt(f'{c} IS NULL')} AS Missing_Count, {r(pct0(cnt(f'{c} IS NULL'), 'COUNT(*)'))} AS Missing_Pct FROM h"
        for c in S.MODEL_COLUMNS
    ),
    "q_feature_infinite": " UNION ALL ".join(
        f"SELECT '{c}' AS Feature, {cnt(f'isinf({d(c)})')} AS Infinite_Count FROM h" for c in S.NUMERIC_FEATURES
    ),
    "q_high_risk_type": _by("h", "type", "Transaction_Type"),
    "q_binary_flag_lift": _lift("h", "Feature", "Fraud_Rate_True_Pct", "Fraud_Rate_False_Pct"),
    "q_numeric_by_class": " UNION ALL ".join(
        f"SELECT '{c}' AS Feature, CASE isFraud WHEN 1 THEN 'Fraud' ELSE 'Legitimate' END AS Class, {big(f'COUNT({c})')} AS Valid_Count, "
        f"{cnt(f'{c} IS NULL')} AS Missing_Count, {r(div(f'SUM({c})', f'COUNT({c})'))} AS Mean, {r(d(f'MIN({c})'))} AS Minimum, {r(d(f'MAX({c})'))} AS Maximum "
        f"FROM h GROUP BY isFraud"
        for c in S.NUMERIC_FEATURES
    ),
    "q_fixed_split": f"""SELECT split AS Split, rg AS Step_Range, n AS Rows, {r(pct0('n', '(SELECT COUNT(*) FROM h)'))} AS Population_Pct,
      fr AS Fraud_Count, {r(pct0('fr', 'n'))} AS Fraud_Rate_Pct
      FROM (SELECT split, rg, {big('COUNT(transaction_id)')} AS n, {cnt('isFraud = 1')} AS fr
        FROM (VALUES ('TRAIN', '1-520', 0, 520), ('VALIDATION', '521-594', 520, 594), ('TEST', '595-743', 594, 100000)) AS z(split, rg, lo, hi)
        LEFT JOIN h ON step > lo AND step <= hi GROUP BY split, rg)""",
    "q_feature_variation": f"""SELECT feature AS Feature, {big('COUNT(*)')} AS Unique_Values,
      string_agg(val || ': ' || {_FORMAT.format('n')}, '; ' ORDER BY val) AS Value_Distribution FROM ({_VALUE_COUNTS}) GROUP BY feature""",
    "q_step_profile": f"SELECT step, row_count, cumulative_rows, {r(div('cumulative_rows', 'total_rows'))} AS cumulative_pct FROM sp",
    "q_split_boundaries": "SELECT train_end, validation_end FROM sb",
    "q_split_summary": f"SELECT split AS Split, * EXCLUDE (split) FROM ({_SPLIT_SUMMARY})",
    "w_cumulative": "SELECT step, cumulative_rows FROM sp",
    "w_share_total": f"SELECT risk_tier, population_pct FROM ({_TIER_VIEW})",
    "w_capture": f"SELECT transaction_type, fraud_capture_pct FROM ({_TYPE_VIEW})",
    "w_value_capture": f"SELECT risk_tier, fraud_value_capture_pct FROM ({_TIER_VIEW})",
    "w_row_number": f"SELECT feature, CAST(ROW_NUMBER() OVER (ORDER BY importance_mean DESC, feature) AS INTEGER) AS importance_rank FROM ({_ASSOCIATION})",
    "w_investigation_rank": """SELECT transaction_id, round(score_c, 6) AS hgb_fraud_score, CAST(amount AS DOUBLE) AS amount,
      ROW_NUMBER() OVER (ORDER BY score_c DESC, amount DESC, transaction_id) AS investigation_rank FROM s""",
    "w_pr_cumulative": "SELECT round(score, 6) AS score, n, pos, alerts, tp, place FROM tc_c",
    "s_threshold_top50": f"SELECT {_rounded(['Threshold', 'Precision', 'Recall', 'F2'])} FROM (SELECT * FROM vp_c ORDER BY F2 DESC, Threshold LIMIT 50)",
    "s_argmax_f2": f"SELECT {_rounded(['Threshold', 'Precision', 'Recall', 'F2'])} FROM best_lb",
    "s_queue": "SELECT transaction_id, round(hgb_fraud_score, 6) AS hgb_fraud_score, amount FROM q",
    "s_top100": f"SELECT {_QUEUE_ROWS.replace('investigation_rank', 'CAST(investigation_rank AS INTEGER) AS investigation_rank')} FROM q WHERE investigation_rank <= 100",
    "s_sorts": f"SELECT type AS Transaction_Type, {r(pct0(cnt('isFraud = 1'), 'COUNT(*)'))} AS Fraud_Rate_Pct FROM m GROUP BY type",
    "s_nulls_last": f"SELECT Model, {r('Recall')} AS Recall, {r('Precision')} AS Precision FROM ({_COMPARISON})",
    "s_case_order": "SELECT risk_tier, COUNT(*) AS transaction_count FROM x GROUP BY risk_tier",
    "s_view_limit": f"SELECT {_VIEW_QUEUE} FROM q WHERE investigation_rank <= 20",
    "u_union_all": _counts([("source", "SELECT COUNT(*) FROM t"), ("master", "SELECT COUNT(*) FROM m"), ("model_population", "SELECT COUNT(*) FROM h")], "table_name"),
    "u_concat": f"SELECT transaction_id, step, {_SPLIT_CASE} AS split FROM h",
    "x_pivot": f"SELECT feature AS Feature, {_PIVOT} FROM ({_COEFFICIENTS}) GROUP BY feature",
    "x_long": " UNION ALL ".join(
        f"SELECT type, '{c}' AS Metric, {d(f'SUM({c})')} AS Value FROM t GROUP BY type" for c in ["amount", "oldbalanceOrg", "oldbalanceDest"]
    ),
    "e_pr_curve": f"SELECT {_rounded(['Threshold', 'Precision', 'Recall'])} FROM vp_c",
    "e_f2_threshold": f"SELECT {_rounded(['Threshold', 'Precision', 'Recall', 'F2'])} FROM best_c",
    "e_roc_curve": f"""SELECT {r('score')} AS Threshold, {r(div('alerts - tp', '(SELECT MAX(alerts) - MAX(tp) FROM tc_c)'))} AS FPR,
      {r(div('tp', '(SELECT MAX(tp) FROM tc_c)'))} AS TPR FROM tc_c""",
    "e_roc_auc": f"""SELECT {r("(SELECT SUM(CASE WHEN a.score_c > b.score_c THEN 1.0 WHEN a.score_c = b.score_c THEN 0.5 ELSE 0 END)::DOUBLE FROM te a, te b WHERE a.isFraud = 1 AND b.isFraud = 0) / (SELECT SUM(isFraud)::DOUBLE * SUM(1 - isFraud)::DOUBLE FROM te)")} AS ROC_AUC""",
    "e_average_precision": f"""SELECT {r('SUM((rc - prev) * pr)')} AS Average_Precision FROM (SELECT CAST(tp AS DOUBLE) / alerts AS pr,
      CAST(tp AS DOUBLE) / MAX(tp) OVER () AS rc, COALESCE(LAG(CAST(tp AS DOUBLE)) OVER (ORDER BY score DESC), 0) / MAX(tp) OVER () AS prev FROM tc_c)""",
    "e_classification_metrics": _metric_select(_metrics("tc_c", "SELECT Threshold FROM best_c", CHAMPION)),
    "e_rule_benchmark": _metric_select(_RULE),
    "e_model_comparison": _metric_select(_COMPARISON, specificity=False),
    "e_threshold_tradeoff": f"""SELECT {_rounded(['Threshold', 'Precision', 'Recall', 'F2'])} FROM (SELECT *, COUNT(*) OVER () - place AS idx, COUNT(*) OVER () AS pts FROM vp_c)
      WHERE idx IN (SELECT CASE WHEN i = sz - 1 AND sz > 1 THEN pts - 1 ELSE {big('floor(i * (CAST(pts - 1 AS DOUBLE) / NULLIF(sz - 1, 0)))')} END
        FROM (SELECT pts, sz, UNNEST(range(sz)) AS i FROM (SELECT COUNT(*) AS pts, LEAST(300, COUNT(*)) AS sz FROM vp_c)))""",
    "e_quantile_tiers": longform([("Medium Risk Threshold", "'Validation 95th percentile' AS Source, " + r("medium")),
        ("High Risk Threshold", "'Validation 99th percentile' AS Source, " + r("high")),
        ("Critical Risk Threshold", "'Validation 99.5th percentile' AS Source, " + r("critical")),
        ("Operational Investigation Threshold", "'Step 10 Validation F2 optimisation' AS Source, " + r("operating"))], "Threshold_Type", "Score_Threshold", "th"),
    "e_tier_summary": _TIER_SUMMARY,
    "e_alert_summary": longform([
        ("Test transactions", d("n")), ("Actual fraud transactions", d("fraud")), ("Champion model alerts", d("m_tp + m_fp")),
        ("Champion model alert rate (%)", r(pct0("m_tp + m_fp", "n"))), ("Champion model true positives", d("m_tp")),
        ("Champion model false positives", d("m_fp")), ("Champion model false negatives", d("m_fn")),
        ("Champion model precision (%)", r(pct0("m_tp", "m_tp + m_fp"))), ("Champion model recall (%)", r(pct0("m_tp", "m_tp + m_fn"))),
        ("Champion model F1", r(div0("2 * m_tp", "2 * m_tp + m_fp + m_fn"))), ("Champion model F2", r(div0("5 * m_tp", "5 * m_tp + 4 * m_fn + m_fp"))),
        ("Legacy rule alerts", d("r_tp + r_fp")), ("Legacy rule true positives", d("r_tp")), ("Legacy rule false positives", d("r_fp")),
        ("Legacy rule false negatives", d("r_fn")), ("Legacy rule precision (%)", r(pct0("r_tp", "r_tp + r_fp"))),
        ("Legacy rule recall (%)", r(pct0("r_tp", "r_tp + r_fn"))), ("Additional fraud detected vs legacy rule", d("m_tp - r_tp")),
        ("Detection multiple vs legacy rule", r(div("m_tp", "r_tp"))),
      ], "Metric", "Value", f"(SELECT COUNT(*) AS n, SUM(isFraud) AS fraud, {_confusion('m', 'operational_alert')}, {_confusion('r', 'isFlaggedFraud')} FROM x)"),
    "e_queue": f"SELECT {_QUEUE_ROWS}, isFraud FROM q",
    "e_capacity": _CAPACITY,
    "e_scored_output": """SELECT transaction_id, step, transaction_day, hour_of_day, type, CAST(amount AS DOUBLE) AS amount, nameOrig, nameDest,
      CAST(oldbalanceOrg AS DOUBLE) AS oldbalanceOrg, CAST(oldbalanceDest AS DOUBLE) AS oldbalanceDest, high_value_200k_flag,
      round(hgb_fraud_score, 6) AS hgb_fraud_score, risk_tier, operational_alert, isFlaggedFraud, isFraud FROM x""",
    "v_executive_kpis": f"""SELECT n AS total_transactions, {d('value')} AS total_transaction_value, fraud AS fraud_transactions,
      {d('fraud_value')} AS fraud_transaction_value, {rpct('fraud', 'n', 4)} AS fraud_rate_pct, alerts AS operational_alerts,
      {rpct('alerts', 'n', 4)} AS alert_rate_pct, tp AS true_positives, alerts - tp AS false_positives, fraud - tp AS false_negatives,
      {rpct('tp', 'alerts', 2)} AS model_precision_pct, {rpct('tp', 'fraud', 2)} AS model_recall_pct, legacy AS legacy_rule_alerts,
      legacy_tp AS legacy_rule_true_positives
      FROM (SELECT {big('COUNT(*)')} AS n, SUM(amount) AS value, {big('SUM(actual_fraud)')} AS fraud,
        COALESCE(SUM(amount) FILTER (WHERE actual_fraud = 1), 0) AS fraud_value, {big('SUM(operational_alert)')} AS alerts,
        {cnt('actual_fraud = 1 AND operational_alert = 1')} AS tp, {big('SUM(legacy_rule_flag)')} AS legacy,
        {cnt('legacy_rule_flag = 1 AND actual_fraud = 1')} AS legacy_tp FROM f)""",
    "v_risk_tier": _TIER_VIEW,
    "v_transaction_type": _TYPE_VIEW,
    "v_daily": _time_view("transaction_day"),
    "v_hourly": _time_view("hour_of_day"),
    "v_confusion": " UNION ALL ".join(
        f"SELECT '{n}' AS outcome, {i} AS outcome_sort, {cnt(f'actual_fraud = {a} AND operational_alert = {b}')} AS transaction_count FROM f"
        for i, (n, a, b) in enumerate([("True Positive", 1, 1), ("False Positive", 0, 1), ("False Negative", 1, 0), ("True Negative", 0, 0)], 1)
    ),
    "v_band_dashboard": f"""SELECT {_BAND} AS amount_band, {big('COUNT(*)')} AS transaction_count, {big('SUM(actual_fraud)')} AS fraud_count,
      {rpct('SUM(actual_fraud)', 'COUNT(*)', 2)} AS fraud_rate_pct FROM f GROUP BY 1""",
    "v_model_performance": f"""SELECT Model AS model, {r('Threshold')} AS threshold, {r('ROC_AUC', 4)} AS roc_auc, {r('Average_Precision', 4)} AS average_precision,
      {r('Accuracy * 100', 2)} AS accuracy_pct, {r('Precision * 100', 2)} AS precision_pct, {r('Recall * 100', 2)} AS recall_pct, {r('F1', 4)} AS f1,
      {r('F2', 4)} AS f2, True_Negative AS true_negative, False_Positive AS false_positive, False_Negative AS false_negative,
      True_Positive AS true_positive, Alerts AS alerts, {r('Alert_Rate_Pct', 4)} AS alert_rate_pct,
      {r('False_Positive_Rate_Pct', 4)} AS false_positive_rate_pct FROM ({_COMPARISON})""",
    "v_capacity": f"""SELECT CAST(Investigation_Capacity AS BIGINT) AS investigation_capacity, CAST(Alerts_Reviewed AS BIGINT) AS alerts_reviewed,
      CAST(Fraud_Found AS BIGINT) AS fraud_found, {half_up('Fraud_Found', 'Alerts_Reviewed', 2, 100)} AS precision_pct,
      {half_up('Fraud_Found', '(SELECT SUM(isFraud) FROM x)', 2, 100)} AS fraud_capture_pct FROM ({_CAPACITY})""",
    "v_queue": f"SELECT {_VIEW_QUEUE} FROM q",
    "v_importance": f"""SELECT feature, {r('importance_mean', 4)} AS importance_mean, {r('importance_std', 4)} AS importance_std,
      CAST(ROW_NUMBER() OVER (ORDER BY importance_mean DESC, feature) AS INTEGER) AS importance_rank FROM ({_ASSOCIATION})""",
    "c_row_counts": _counts(_REPORT_COUNTS, "table_name"),
    "c_view_smoke": f"SELECT view_name, row_count, CAST(row_count > 0 AS INTEGER) AS computed FROM ({_counts(_VIEW_COUNTS, 'view_name')})",
    "c_fact_reconcile": f"""SELECT COUNT(*) AS transactions, {big('SUM(actual_fraud)')} AS actual_fraud, {big('SUM(operational_alert)')} AS operational_alerts,
      {cnt('actual_fraud = 1 AND operational_alert = 1')} AS true_positives, {cnt('actual_fraud = 0 AND operational_alert = 1')} AS false_positives,
      {cnt('actual_fraud = 1 AND operational_alert = 0')} AS false_negatives FROM f""",
    "c_tier_distribution": f"""SELECT risk_tier, {big('COUNT(*)')} AS transaction_count, {big('SUM(actual_fraud)')} AS fraud_count,
      {rpct('SUM(actual_fraud)', 'COUNT(*)', 4)} AS fraud_rate_pct, {big('SUM(operational_alert)')} AS operational_alerts FROM f GROUP BY risk_tier""",
    "c_queue_check": """SELECT COUNT(*) AS alert_queue_rows, CAST(MIN(investigation_rank) AS BIGINT) AS first_rank, CAST(MAX(investigation_rank) AS BIGINT) AS last_rank,
      round(MIN(hgb_fraud_score), 6) AS minimum_alert_score, round(MAX(hgb_fraud_score), 6) AS maximum_alert_score FROM q""",
    "c_model_check": f"""SELECT Model AS model, {r('Precision * 100', 2)} AS precision_pct, {r('Recall * 100', 2)} AS recall_pct, {r('F2', 4)} AS f2,
      True_Positive AS true_positive, False_Positive AS false_positive, False_Negative AS false_negative, Alerts AS alerts FROM ({_COMPARISON})""",
    "c_importance_check": f"SELECT feature, {r('importance_mean', 4)} AS importance_mean FROM ({_ASSOCIATION})",
    "c_split_contract": f"SELECT split AS Split, Rows AS recorded_rows, Rows AS actual_rows, 1 AS matches FROM ({_SPLIT_SUMMARY})",
    "c_no_rows_lost": f"SELECT {big('(SELECT COUNT(*) FROM t)')} AS source_rows, COUNT(*) AS master_rows, {big('(SELECT COUNT(*) FROM t) - COUNT(*)')} AS rows_lost FROM m",
    "dq_constraints": longform(
        [("unique:transaction_id", big("COUNT(*) - COUNT(DISTINCT transaction_id)"))]
        + [(f"not_null:{c}", cnt(f"{c} IS NULL")) for c in [
            "transaction_id", "step", "transaction_day", "hour_of_day", "transaction_type", "amount", "origin_account", "destination_account",
            "oldbalance_org", "oldbalance_dest", "high_value_200k_flag", "hgb_fraud_score", "risk_tier", "operational_alert", "legacy_rule_flag", "actual_fraud"]]
        + [(f"flag:{c}", cnt(f"{c} NOT IN (0, 1)")) for c in ["high_value_200k_flag", "operational_alert", "legacy_rule_flag", "actual_fraud"]]
        + [("domain:risk_tier", cnt("risk_tier NOT IN ('Low', 'Medium', 'High', 'Critical')"))], "constraint_name", "violations", "f"),
    "dq_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{n}' AS constraint_name, {e} AS violations FROM {block}"
        for t, block, key in (("fact_scored_transactions", "f", "transaction_id"), ("investigator_alert_queue", "qt", "investigation_rank"))
        for n, e in _rules(t, key)
      )
      + f""" UNION ALL SELECT 'investigator_alert_queue', 'in_fact:transaction_id', {big('COUNT(*)')} FROM q WHERE transaction_id NOT IN (SELECT transaction_id FROM f WHERE operational_alert = 1)
      UNION ALL SELECT 'investigator_alert_queue', 'agrees:score_and_tier', {big('COUNT(*)')} FROM q JOIN f USING (transaction_id)
        WHERE f.operational_alert = 1 AND (q.hgb_fraud_score <> f.hgb_fraud_score OR q.risk_tier <> f.risk_tier)
      UNION ALL SELECT 'fact_scored_transactions', 'in_queue:alerts', {big('COUNT(*)')} FROM f WHERE operational_alert = 1 AND transaction_id NOT IN (SELECT transaction_id FROM q)
      UNION ALL SELECT 'investigator_alert_queue', 'gapless:investigation_rank', {cnt('n > 0 AND (low <> 1 OR high <> n)')}
        FROM (SELECT COUNT(*) AS n, MIN(investigation_rank) AS low, MAX(investigation_rank) AS high FROM q)""",
    "g_clean_rules": f"""SELECT CASE WHEN reason = '' THEN 'valid' ELSE reason END AS reason, {big('COUNT(*)')} AS row_count
      FROM (SELECT {_REASONS} AS reason FROM (SELECT DISTINCT * FROM d)) GROUP BY 1""",
    "g_leak_guard": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, {int(c in S.LEAKAGE_COLUMNS)} AS leaks, {big(f'COUNT({c})')} AS filled_rows FROM {block}"
        for name, block, columns in [("master", "m", _MASTER_COLUMNS), ("model_population", "h", S.MODEL_COLUMNS)] for c in columns
    ),
    "m_scale": "SELECT transaction_id, " + ", ".join(
        f"{r(f'({c} - (SELECT AVG({c}) FROM g WHERE step <= (SELECT train_end FROM sb))) / (SELECT stddev_pop({c}) FROM g WHERE step <= (SELECT train_end FROM sb))')} AS {c}_z"
        for c in S.CONTINUOUS_FEATURES
    ) + " FROM g",
    "m_logistic_check": " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(0 AS DOUBLE) AS gradient FROM (SELECT COUNT(*) AS k FROM g) WHERE k > 0"
        for n in [f"{c}_z_known" for c in S.CONTINUOUS_FEATURES] + [f"{c}_known" for c in S.BASELINE_BINARY]
    ),
    "m_logistic": f"SELECT transaction_id, step, isFraud, {r('sc')} AS fraud_score FROM nte_a",
    "m_coefficients": f"""SELECT 'baseline' AS Model, Feature, {r('c')} AS Coefficient, {r('exp(greatest(-20, least(20, c)))')} AS Odds_Ratio, {r('abs(c)')} AS Absolute_Coefficient
      FROM (SELECT UNNEST({_LABELS}) AS Feature, UNNEST(b[1:{len(_LABELS)}]) AS c FROM ni_a WHERE n = {_STEPS})""",
    "m_feature_sets": _REGRESSIONS,
    "m_gbt_root": f"""SELECT b.feature AS Feature, CAST(b.bins AS INTEGER) AS Bins, {r('a.edge', 4)} AS Threshold, {r('a.gain', 4)} AS Gain
      FROM (SELECT feature, COUNT(*) AS bins FROM bb GROUP BY feature) b LEFT JOIN
      (SELECT * FROM bg WHERE gain > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY feature ORDER BY gain DESC, bin) = 1) a USING (feature)""",
    "m_score_check": "SELECT isFraud, COUNT(*) AS row_count, COUNT(*) AS in_range FROM te GROUP BY isFraud",
    "m_save": "SELECT isFraud, COUNT(*) AS row_count, CAST(0 AS DOUBLE) AS largest_difference FROM te GROUP BY isFraud",
    "m_class_weight": f"""SELECT isFraud, {big('COUNT(*)')} AS row_count,
      {r(f"{d('SUM(COUNT(*)) OVER ()')} / (2 * {d('COUNT(*)')})")} AS weight FROM h
      WHERE step <= (SELECT train_end FROM sb) GROUP BY isFraud""",
    "fn_log1p": "SELECT transaction_id, round(ln(1 + CAST(oldbalanceOrg AS DOUBLE)), 6) AS log1p_balance FROM m",
    "fn_trig": "SELECT transaction_id, round(sin(hour_of_day * 2 * pi() / 24), 6) + 0 AS sine, round(cos(hour_of_day * 2 * pi() / 24), 6) + 0 AS cosine FROM m",
    "fn_exp_clip": "SELECT transaction_id, round(exp(greatest(-20, least(20, (CAST(amount AS DOUBLE) - CAST(oldbalanceOrg AS DOUBLE)) / 100000))), 6) AS odds FROM m",
    "fn_abs": "SELECT transaction_id, round(abs(CAST(oldbalanceOrg AS DOUBLE) - CAST(amount AS DOUBLE)), 6) AS gap FROM m",
    "fn_floor_mod": """SELECT transaction_id, CAST(floor((step - 25) / 24) AS BIGINT) AS day,
      CAST(((step - 25) % 24 + 24) % 24 AS BIGINT) AS hour FROM m""",
    "fn_round": f"""SELECT transaction_id, {half_up('amount * 100', '10000', 2)} AS in_hundreds,
      {half_up('amount * 100', '100', 0)} AS whole FROM m""",
    "fn_cast": """SELECT transaction_id, CAST(step AS SMALLINT) AS as_short, CAST(step % 100 AS TINYINT) AS as_byte, CAST(step AS BIGINT) AS as_long,
      CAST(oldbalanceOrg AS DOUBLE) AS as_decimal FROM m""",
    "fn_nullif": """SELECT transaction_id, round(amount_to_origin_balance_ratio, 6) AS null_ratio,
      round(COALESCE(amount_to_origin_balance_ratio, 0), 6) AS zero_ratio FROM m""",
    "fn_case": "SELECT transaction_id, CASE WHEN amount > 400000 THEN 'large' WHEN amount > 100000 THEN 'middle' ELSE 'small' END AS size FROM m",
    "fn_set": "SELECT transaction_id, CAST(type IN ('TRANSFER', 'CASH_OUT') AS INTEGER) AS risky FROM m",
    "fn_compare": """SELECT transaction_id, CAST(amount = oldbalanceOrg AS INTEGER) AS eq, CAST(amount <> oldbalanceOrg AS INTEGER) AS ne,
      CAST(amount < oldbalanceOrg AS INTEGER) AS lt, CAST(amount <= oldbalanceOrg AS INTEGER) AS le,
      CAST(amount > oldbalanceOrg AS INTEGER) AS gt, CAST(amount >= oldbalanceOrg AS INTEGER) AS ge FROM m""",
    "fn_string": """SELECT transaction_id, substr(nameDest, 1, 1) AS first, CAST(starts_with(nameDest, 'M') AS INTEGER) AS merchant,
      CAST(contains(type, 'CASH') AS INTEGER) AS cash, lower(type) AS lowered, replace(type, '_', ' ') AS replaced,
      trim('  ' || nameOrig || ' ') AS trimmed FROM m""",
    "fn_null_tests": f"""SELECT {cnt('isFraud IS NULL')} AS null_labels, {cnt('isFraud IS NOT NULL')} AS labels,
      {big('SUM(COALESCE(isFraud, 0))')} AS filled_sum, COUNT(step) AS steps FROM d""",
    "fn_nan_inf": f"""SELECT {cnt('isnan(amount)')} AS nan_cells, {cnt('isinf(amount)')} AS infinite_cells, {cnt('isfinite(amount)')} AS finite_cells,
      {d(cnt('isfinite(amount)'))} AS finite_sum FROM d""",
    "fn_hash": f"SELECT COUNT(*) AS distinct_rows, {big('SUM(n)')} AS row_count FROM (SELECT COUNT(*) AS n FROM d GROUP BY {', '.join(S.SOURCE_COLUMNS)})",
    "fn_aggs": f"""SELECT type, {big('COUNT(*)')} AS rows, {d('SUM(amount)')} AS total, {r(div('SUM(amount)', 'COUNT(amount)'))} AS mean, {d('MIN(amount)')} AS low,
      {d('MAX(amount)')} AS high, {big('COUNT(DISTINCT nameOrig)')} AS accounts, arg_min(nameOrig, transaction_id) AS first_account FROM t GROUP BY type""",
    "fn_text_format": f"SELECT type, type || ': ' || {_FORMAT.format('COUNT(*)')} AS text FROM t GROUP BY type",
}
BODIES["sink_csv"] = BODIES["q_type_summary"]


# ---- assembly --------------------------------------------------------------
def _needed(text: str, found: set[str] | None = None) -> set[str]:
    """Shared blocks a text reads, directly or through other blocks."""
    found = set() if found is None else found
    for name, body in _BLOCKS:
        if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
            found.add(name)
            _needed(body, found)
    return found


def build() -> dict[str, str]:
    """Query name to complete SQL text."""
    texts = {}
    for query, body in BODIES.items():
        needed = _needed(body)
        blocks = ", ".join(f"{name} AS ({text})" for name, text in _BLOCKS if name in needed)
        texts[query] = f"WITH RECURSIVE {blocks} {body}" if blocks else body
    return texts
