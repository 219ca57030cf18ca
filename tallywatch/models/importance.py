"""Permutation importance of the champion on the validation rows.

A shuffle is an affine map of row numbers: row i takes one column from row
``(a i + b) mod n`` with ``a`` prime to ``n``. That is a permutation of all rows,
found by an equi-join on the donor's number, with no sort of the rows per
shuffle and no group that holds them all.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import double, text
from tallywatch.models.estimators import Model, score
from tallywatch.operators.ordering import global_row_number, running_totals
from tallywatch.session import materialise


def seeded_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows, chosen by a seeded hash of the key."""
    part = math.ceil((1 << 40) * rows / max(1, df.count()))
    return df.where(f"pmod(xxhash64({seed}, transaction_id), {1 << 40}) < {part}")


def affine_maps(n: int, runs: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) per run with a prime to n; a stays below 2**20, so that a * i fits a long."""
    draw, out = random.Random(seed), []
    while len(out) < runs:
        a = draw.randrange(1, 1 << 20)
        if math.gcd(a, n) == 1:
            out.append((a, draw.randrange(n)))
    return out


def grouped_average_precision(scored: DataFrame, key: str) -> DataFrame:
    """Average precision per value of a key with few values, however many rows each has."""
    points = scored.groupBy(key, "score").agg(
        F.expr("COUNT(*) AS n"), F.expr("COUNT_IF(isFraud <=> 1) AS pos")
    )
    own = running_totals(points, ["score DESC"], {"alerts": "n", "tp": "pos"}, segments=[key])
    area = f"SUM({double('pos')} * {double('tp')} / {double('alerts')}) / NULLIF({double('SUM(pos)')}, 0D)"
    return own.groupBy(key).agg(F.expr(f"{area} AS ap"))


def permutation_importance(
    model: Model,
    validation: DataFrame,
    features: list[str] = S.CHAMPION_FEATURES,
    repeats: int = 3,
    rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the drop in average precision per feature.

    All shuffles are scored in one frame: the rows once per feature and repeat,
    plus once untouched. All rows count; ``rows`` asks for a sample of about so
    many instead. NULL when only one class is present.
    """
    chosen = validation if rows is None else seeded_sample(validation, rows, seed)
    chosen = chosen.select("transaction_id", *features, "isFraud")
    base = materialise(global_row_number(chosen, ["transaction_id"], "place").selectExpr("*", "place - 1 AS spot").drop("place"))
    n = base.count()
    maps = iter(affine_maps(max(1, n), len(features) * repeats, seed))
    runs = [(0, "", 1, 0)] + [(k + 1, f, *next(maps)) for k, f in enumerate(f for f in features for _ in range(repeats))]
    listed = ", ".join(f"struct({k} AS run, {text(f)} AS feature, {a}L AS a, {b}L AS b)" for k, f, a, b in runs)
    copies = base.selectExpr("*", f"inline(array({listed}))").selectExpr("*", f"pmod(a * spot + b, {max(1, n)}L) AS donor")
    donors = base.selectExpr("spot AS donor", *[f"{double(f)} AS {f}_d" for f in features])
    shuffled = copies.join(donors, "donor").selectExpr(
        "run", "isFraud", *[f"CASE WHEN feature = {text(f)} THEN {f}_d ELSE {double(f)} END AS {f}" for f in features]
    )
    areas = grouped_average_precision(score(model, shuffled), "run")
    names = " ".join(f"WHEN {k} THEN {text(f)}" for k, f, _, _ in runs)
    areas = areas.selectExpr("run AS turn", f"CASE run {names} END AS feature", "ap")
    base_ap = areas.where("turn = 0").selectExpr("MAX(ap)").scalar()
    classes = base.selectExpr("COUNT(DISTINCT isFraud)").scalar()
    drops = areas.where("turn > 0").withColumns({"base": base_ap, "classes": classes})
    return (
        drops.groupBy("feature")
        .agg(
            F.expr("AVG(CASE WHEN classes = 2 THEN base - ap END) AS Importance_Mean"),
            F.expr("stddev_pop(CASE WHEN classes = 2 THEN base - ap END) AS Importance_STD"),
        )
        .withColumnRenamed("feature", "Feature")
        .orderBy(F.desc("Importance_Mean"), F.asc("Feature"))
    )
