"""Curves, thresholds and metrics of a scored frame.

Everything starts from one *score curve*: one row per distinct score with its
row and fraud counts, and the running counts from the highest score down. Equal
scores form one point. The rows are counted per score before any ordering, and
the running counts use range partitions with offsets, so no task ever holds the
whole curve. All other results are aggregates or projections of the curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import (
    count_if, curve_f2, double, is_one, percent_or_zero, ratio, ratio_or_zero, sum_if, text,
)
from tallywatch.operators.filters import FRAUD
from tallywatch.operators.ordering import running_totals


def score_curve(
    scored: DataFrame, score: str = "score", label: str = "isFraud", partitions: int | None = None
) -> DataFrame:
    """(score, n, pos, alerts, tp, place): running counts from the top score."""
    groups = (
        scored.where(f"{score} IS NOT NULL")
        .groupBy(F.expr(f"{double(score)} AS score"))
        .agg(F.expr("COUNT(*) AS n"), F.expr(f"{count_if(is_one(label))} AS pos"), F.expr("1L AS one"))
    )
    sums = {"alerts": "n", "tp": "pos", "place": "one"}
    return running_totals(groups, ["score DESC"], sums, partitions).drop("one")


def segmented_curve(long: DataFrame, by: list[str], score: str = "score", label: str = "isFraud") -> DataFrame:
    """The curves of many models and periods in one plan: ``by``, then the columns of ``score_curve``.

    ``long`` has a row per row, model and period. One group-by and one range
    exchange serve all curves.
    """
    groups = (
        long.where(f"{score} IS NOT NULL")
        .groupBy(*by, F.expr(f"{double(score)} AS score"))
        .agg(F.expr("COUNT(*) AS n"), F.expr(f"{count_if(is_one(label))} AS pos"), F.expr("1L AS one"))
    )
    return running_totals(groups, ["score DESC"], {"alerts": "n", "tp": "pos", "place": "one"}, segments=by).drop("one")


def unpivoted_scores(rows: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per row and model: ``keep``, model, score. ``columns`` maps a model to its score column."""
    cells = ", ".join(f"struct({text(model)} AS model, {double(column)} AS score)" for model, column in columns.items())
    return rows.selectExpr(*keep, f"inline(array({cells}))")


def segmented_thresholds(curves: DataFrame, by: str = "model") -> DataFrame:
    """(``by``, Threshold, Precision, Recall, F2): the best F2 of each curve, the lowest threshold among equals."""
    whole = curves.groupBy(by).agg(F.expr("MAX(tp) AS fraud"))  # one row per curve
    points = curves.join(F.broadcast(whole), by).selectExpr(
        by, "score AS Threshold", f"{ratio('tp', 'alerts')} AS Precision", f"{ratio('tp', 'fraud')} AS Recall"
    )
    best = points.selectExpr("*", f"{curve_f2('Precision', 'Recall')} AS F2").groupBy(by).agg(
        F.expr("MAX(struct(F2, -Threshold AS low, Precision, Recall)) AS b")
    )
    return best.selectExpr(by, "-b.low AS Threshold", "b.Precision", "b.Recall", "b.F2")


def segmented_metrics(curves: DataFrame, cuts: DataFrame, by: str = "model") -> DataFrame:
    """Metric rows of many curves, each at its own Threshold in ``cuts``; one aggregate."""
    cells = (
        curves.join(F.broadcast(cuts.selectExpr(by, "Threshold AS cut")), by)  # one row per curve
        .groupBy(by)
        .agg(*map(F.expr, [*_AREA_SUMS, "MAX(cut) AS cut", *_CUT_SUMS]))
    )
    return _metric_row(cells, by, "cut", _ROC_AUC, _AVERAGE_PRECISION, literal=False)


def _with_totals(curve: DataFrame) -> DataFrame:
    """Add rows, fraud and points of the whole curve, from a one-row subquery."""
    whole = "struct(MAX(alerts) AS rows, MAX(tp) AS fraud, MAX(place) AS points)"
    return curve.withColumn("whole", curve.selectExpr(whole).scalar())


def pr_curve(curve: DataFrame) -> DataFrame:
    """Precision, recall and F2 at every distinct score."""
    return (
        _with_totals(curve)
        .selectExpr(
            "score AS Threshold",
            f"{ratio('tp', 'alerts')} AS Precision",
            f"{ratio('tp', 'whole.fraud')} AS Recall",
            "place",
            "whole.points AS points",
        )
        .selectExpr("*", f"{curve_f2('Precision', 'Recall')} AS F2")
    )


def roc_curve(curve: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return _with_totals(curve).selectExpr(
        "score AS Threshold",
        f"{ratio('alerts - tp', 'whole.rows - whole.fraud')} AS FPR",
        f"{ratio('tp', 'whole.fraud')} AS TPR",
    )


# ---- areas -----------------------------------------------------------------
_AREA_SUMS = [
    "MAX(alerts) AS all_rows",
    "MAX(tp) AS all_fraud",
    # Half credit for the fraud inside an equal score.
    f"SUM({double('n - pos')} * ({double('tp')} - {double('pos')} / 2D)) AS auc_sum",
    f"SUM({double('pos')} * ({double('tp')} / {double('alerts')})) AS ap_sum",
]
_ROC_AUC = f"auc_sum / NULLIF({double('all_fraud')} * {double('all_rows - all_fraud')}, 0D)"
#: Step-wise area (no interpolation); 0 without any fraud.
_AVERAGE_PRECISION = f"CASE WHEN all_fraud = 0 THEN 0D ELSE ap_sum / NULLIF({double('all_fraud')}, 0D) END"


def roc_auc(curve: DataFrame) -> DataFrame:
    return curve.selectExpr(*_AREA_SUMS).selectExpr(f"{_ROC_AUC} AS ROC_AUC")


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.selectExpr(*_AREA_SUMS).selectExpr(f"{_AVERAGE_PRECISION} AS Average_Precision")


# ---- thresholds ------------------------------------------------------------
def f2_threshold(curve: DataFrame) -> DataFrame:
    """One row: the threshold of the largest F2, the lowest among equals."""
    best = pr_curve(curve).selectExpr("MAX(struct(F2, -Threshold AS low, Precision, Recall)) AS b")
    return best.selectExpr("-b.low AS Threshold", "b.Precision", "b.Recall", "b.F2")


def top_thresholds(curve: DataFrame, count: int = 50) -> DataFrame:
    """The best thresholds by F2; the report's own limit."""
    ranked = pr_curve(curve).orderBy(F.desc("F2"), F.asc("Threshold")).limit(count)
    return ranked.select("Threshold", "Precision", "Recall", "F2")


def threshold_tradeoff(curve: DataFrame, points: int = 300) -> DataFrame:
    """Up to ``points`` evenly spaced curve points, in threshold order."""
    wanted = (
        curve.selectExpr("MAX(place) AS points")
        .selectExpr("points", f"least({points}L, points) AS size")
        .where("size > 0")
        .selectExpr("points", "size", "explode(sequence(0L, size - 1)) AS i")
        .selectExpr(
            "CASE WHEN i = size - 1 AND size > 1 THEN points - 1 ELSE COALESCE(floor("
            f"{double('i')} * ({double('points - 1')} / NULLIF({double('size - 1')}, 0D))), 0L) END AS idx"
        )
        .distinct()
    )
    indexed = pr_curve(curve).selectExpr("points - place AS idx", "Threshold", "Precision", "Recall", "F2")
    return indexed.join(F.broadcast(wanted), "idx", "left_semi").drop("idx")


def curve_quantiles(curve: DataFrame, quantiles: list[tuple[str, float]]) -> DataFrame:
    """Exact linearly interpolated quantiles of the scores, one row.

    Read off the running counts: the score whose rows cover a sorted position.
    The built-in exact percentile would gather every distinct score in one task.
    """
    below = "(whole.rows - alerts)"  # rows with a lower score
    measures: list[str] = []
    for name, q in quantiles:
        position = f"({double('whole.rows - 1')} * {q!r}D)"
        for side, index in (("lo", f"floor({position})"), ("hi", f"ceil({position})")):
            covers = f"{below} <= {index} AND {index} < {below} + n"
            measures.append(f"MAX(score) FILTER (WHERE {covers}) AS {name}_{side}")
        measures.append(f"MAX({position} - floor({position})) AS {name}_part")
    return (
        _with_totals(curve)
        .selectExpr(*measures)
        .selectExpr(*[f"{n}_lo + ({n}_hi - {n}_lo) * {n}_part AS {n}" for n, _ in quantiles])
    )


# ---- metric rows -----------------------------------------------------------
# Fields of a metric row, in order.
_METRIC_FIELDS = {
    "Accuracy": ratio_or_zero("tp + tn", "tp + fp + tn + fn"),
    "Precision": ratio_or_zero("tp", "tp + fp"),
    "Recall": ratio_or_zero("tp", "tp + fn"),
    "F1": ratio_or_zero("2 * tp", "2 * tp + fp + fn"),
    "F2": ratio_or_zero("5 * tp", "5 * tp + 4 * fn + fp"),
    "Specificity": ratio_or_zero("tn", "tn + fp"),
    "True_Negative": "tn",
    "False_Positive": "fp",
    "False_Negative": "fn",
    "True_Positive": "tp",
    "Alerts": "tp + fp",
    "Alert_Rate_Pct": percent_or_zero("tp + fp", "tp + fp + tn + fn"),
    "False_Positive_Rate_Pct": percent_or_zero("fp", "fp + tn"),
}


_CUT_SUMS = [
    f"{sum_if('score >= cut', 'pos')} AS tp",
    f"{sum_if('score >= cut', 'n - pos')} AS fp",
    f"{sum_if('score < cut', 'n - pos')} AS tn",
    f"{sum_if('score < cut', 'pos')} AS fn",
]


def _metric_row(cells: DataFrame, model: str, threshold: str, auc: str, ap: str, literal: bool = True) -> DataFrame:
    """The 17 fields from tp, fp, tn, fn; undefined ratios are 0."""
    return cells.selectExpr(
        f"{text(model) if literal else model} AS Model",
        f"{double(threshold)} AS Threshold",
        f"{double(auc)} AS ROC_AUC",
        f"{double(ap)} AS Average_Precision",
        *[f"{expression} AS {name}" for name, expression in _METRIC_FIELDS.items()],
    )


def classification_metrics(curve: DataFrame, threshold: float | Column, model: str) -> DataFrame:
    """Metrics of a score at a threshold: a single aggregate over its curve.

    The threshold is a number or a one-row subquery (``frame.scalar()``).
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cells = curve.withColumn("cut", cut).selectExpr(
        *_AREA_SUMS,
        "MAX(cut) AS cut",
        *_CUT_SUMS,
    )
    return _metric_row(cells, model, "cut", _ROC_AUC, _AVERAGE_PRECISION)


def rule_metrics(period: DataFrame, flag: str = "isFlaggedFraud", model: str = S.RULE_MODEL) -> DataFrame:
    """The same fields for the existing rule; it has no score, so no areas."""
    hit = is_one(flag)
    cells = period.selectExpr(
        f"{count_if(f'{FRAUD} AND {hit}')} AS tp",
        f"{count_if(f'NOT {FRAUD} AND {hit}')} AS fp",
        f"{count_if(f'NOT {FRAUD} AND NOT {hit}')} AS tn",
        f"{count_if(f'{FRAUD} AND NOT {hit}')} AS fn",
    )
    return _metric_row(cells, model, "NULL", "NULL", "NULL")


def model_comparison(rows: list[DataFrame], with_specificity: bool = True) -> DataFrame:
    """Metric rows under each other."""
    table = rows[0]
    for other in rows[1:]:
        table = table.unionByName(other)
    return table if with_specificity else table.drop("Specificity")


def predictions(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """0/1 predictions: output name to (score column, threshold)."""
    made = [
        f"CAST(COALESCE({score} >= {float(cut)!r}D, FALSE) AS TINYINT) AS {name}"
        for name, (score, cut) in columns.items()
    ]
    return df.selectExpr("*", *made)
