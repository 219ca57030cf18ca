"""Global ranks and running totals against plain Python, with hot values."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallywatch.operators import evaluate as ev
from tallywatch.operators.ordering import bounded_rank, global_row_number, running_totals


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_global_row_number_with_hot_value(spark, partitions):
    rng = random.Random(5)
    pairs = [(i, 7.0 if i % 3 == 0 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(pairs, "k long, v double").repartition(5)
    got = {r["k"]: r["place"] for r in global_row_number(df, ["v DESC", "k"], "place", partitions).collect()}
    order = sorted(pairs, key=lambda p: (-p[1], p[0]))
    assert got == {k: i for i, (k, _) in enumerate(order, start=1)}


def test_global_row_number_of_nothing(spark):
    df = spark.createDataFrame([], "k long, v double")
    assert global_row_number(df, ["v DESC", "k"], "place").count() == 0


def test_hot_value_is_spread(spark):
    df = spark.range(40000).selectExpr("id AS k", "CAST(id % 10 < 4 AS DOUBLE) AS v")
    placed = df.repartitionByRange(8, F.desc("v"), F.asc("k")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in placed.collect()) < 40000 / 4


def test_running_totals(spark):
    df = spark.createDataFrame([(float(i), i % 4, 1) for i in range(500)], "v double, n long, one long").repartition(7)
    out = running_totals(df, ["v DESC"], {"c": "n", "place": "one"}, 6).collect()
    done, want = 0, {}
    for v in sorted((r["v"] for r in out), reverse=True):
        done += int(v) % 4
        want[v] = done
    assert {r["v"]: r["c"] for r in out} == want
    assert {r["place"] for r in out} == set(range(1, 501))


def test_bounded_rank(spark):
    df = spark.range(100).selectExpr("id AS k", "id % 10 AS v")
    got = [(r["v"], r["k"]) for r in bounded_rank(df, ["v DESC", "k"], 12, "p").orderBy("p").collect()]
    assert got == sorted([(i % 10, i) for i in range(100)], key=lambda p: (-p[0], p[1]))[:12]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=2, max_size=60))
def test_areas_threshold_and_quantiles_by_brute_force(spark, pairs):
    scores, labels = [s / 12 for s, _ in pairs], [y for _, y in pairs]
    curve = ev.score_curve(spark.createDataFrame(list(zip(scores, labels)), "score double, isFraud int"))
    metric = ev.classification_metrics(curve, 0.5, "m").first()
    positives, negatives = sum(labels), len(labels) - sum(labels)
    if positives and negatives:
        wins = sum((a > b) + (a == b) / 2 for a, x in zip(scores, labels) for b, y in zip(scores, labels) if x and not y)
        assert metric["ROC_AUC"] == pytest.approx(wins / positives / negatives)
    if positives:
        area, last, points = 0.0, 0.0, []
        for cut in sorted(set(scores), reverse=True):
            chosen = [y for s, y in zip(scores, labels) if s >= cut]
            p, r = sum(chosen) / len(chosen), sum(chosen) / positives
            area, last = area + (r - last) * p, r
            points.append((5 * p * r / (4 * p + r + 1e-12), -cut))
        assert metric["Average_Precision"] == pytest.approx(area)
        best = ev.f2_threshold(curve).first()
        assert best["F2"] == pytest.approx(max(points)[0]) and best["Threshold"] == -max(points)[1]
    assert metric["True_Positive"] == sum(y for s, y in zip(scores, labels) if s >= 0.5)
    frame = spark.createDataFrame([(s,) for s in scores], "s double")
    built_in = frame.selectExpr("percentile(s, array(0.95, 0.99, 0.995))").first()[0]
    ours = ev.curve_quantiles(curve, [("a", 0.95), ("b", 0.99), ("c", 0.995)]).first()
    assert list(ours) == pytest.approx(built_in)


def test_tradeoff_points_match_linspace(spark):
    import numpy as np

    for size in (1, 2, 7, 299, 300, 301, 1000):
        curve = ev.score_curve(spark.range(size).selectExpr("id / 1000D AS score", "CAST(id % 2 AS INT) AS isFraud"))
        got = sorted(round(r["Threshold"] * 1000) for r in ev.threshold_tradeoff(curve).collect())
        assert got == sorted(set(np.linspace(0, size - 1, num=min(300, size), dtype=int).tolist()))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_running_totals_of_segments(spark, batch):
    rng = random.Random(2)
    rows = sorted({(rng.choice("abbbbbbc"), i, rng.randrange(5)) for i in range(700)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "s string, v long, n long").repartition(5)
        got = {(r["s"], r["v"]): r["c"] for r in running_totals(df, ["v DESC"], {"c": "n"}, 6, ["s"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {(s, v): sum(n for t, w, n in rows if t == s and w >= v) for s, v, _ in rows}
    empty = running_totals(df.limit(0), ["v DESC"], {"c": "n"}, 3, ["s"])
    assert empty.count() == 0 and empty.columns == ["s", "v", "n", "c"]


def test_segmented_metrics_are_those_of_single_curves(spark):
    rng = random.Random(8)
    rows = [(m, rng.randrange(30) / 30, int(rng.random() < 0.3)) for m in ("x", "y") for _ in range(200)] + [("z", 0.5, 0)]
    long = spark.createDataFrame(rows, "model string, score double, isFraud int")
    curves = ev.segmented_curve(long, ["model"])
    cuts = ev.segmented_thresholds(curves)
    both = {r["Model"]: r.asDict() for r in ev.segmented_metrics(curves, cuts).collect()}
    for m in ("x", "y", "z"):
        own = ev.score_curve(long.where(f"model = '{m}'"))
        cut = ev.f2_threshold(own).first()
        assert cuts.where(f"model = '{m}'").drop("model").first() == cut
        assert both[m] == ev.classification_metrics(own, cut["Threshold"] if cut["Threshold"] is not None else 0.5, m).first().asDict()
