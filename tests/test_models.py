"""Fitted models: objective, determinism of weights, persistence, importance."""

import numpy as np
import pytest

from tallywatch import schema as S
from tallywatch.models import estimators as es, importance, scaling, stress
from tallywatch.models.boosting import load_trees
from tallywatch.operators.compare import coefficient_pivot, delta_vs_baseline
from tallywatch.operators.features import model_features
from tallywatch.operators.filters import in_split
from tallywatch.plans import frames as fr

EVERY = [c for part in S.FEATURE_SETS["Model_D_Enhanced_PaySim"][:2] for c in part]


@pytest.fixture(scope="module")
def parts(spark, data):
    rows = model_features(fr.population(spark, data), EVERY).cache()
    bounds = fr.bounds(spark, data)
    return {n: in_split(rows, n, *bounds) for n in ("TRAIN", "VALIDATION", "TEST")}


@pytest.fixture(scope="module")
def champion(parts):
    return es.fit_boosted_trees(parts["TRAIN"], iterations=5)


def plain_booster(x, y, weights, trees, rules):
    """One split at a time over sorted values; every leaf is searched whole."""
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f][~np.isnan(x[:, f])])
        if len(v) > 255:
            known = np.sort(x[:, f][~np.isnan(x[:, f])])
            bins = np.searchsorted(known, v, side="left") * 255 // len(known)
            first = np.flatnonzero(np.diff(bins)) + 1
        else:
            first = np.arange(1, len(v))
        edges.append((v[first - 1] + v[first]) / 2)
    raw, found = np.zeros(len(y)), []
    w = np.where(y == 1, weights[1], weights[0])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        side = lambda m: g[m].sum() ** 2 / (h[m].sum() + rules.penalty)

        def search(rows):
            best = (0, None)
            for f in range(x.shape[1]):
                gone = np.isnan(x[rows, f])
                for missing_left in (False, True):
                    for cut in [*edges[f], np.inf]:
                        left = np.where(gone, missing_left, x[rows, f] <= cut)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) >= rules.least_rows and min(h[a].sum(), h[b].sum()) >= 1e-3:
                            gain = side(a) + side(b) - side(rows)
                            if gain > best[0] * (1 + 1e-9) + 1e-9:
                                best = (gain, (f, cut, a, b))
            return best

        leaves = {1: np.arange(len(y))}
        gains = {1: search(leaves[1])}
        while len(leaves) < rules.leaves and max(v[0] for n, v in gains.items() if n in leaves) > 0:
            n = min(leaves, key=lambda k: (-gains[k][0], k))
            _, (f, cut, a, b) = gains[n]
            del leaves[n]
            for c, rows in ((2 * n, a), (2 * n + 1, b)):
                leaves[c], gains[c] = rows, search(rows)
        for rows in leaves.values():
            raw[rows] -= rules.step * g[rows].sum() / (h[rows].sum() + rules.penalty)
        found.append(sorted(tuple(sorted(v.tolist())) for v in leaves.values()))
    return raw, found


@pytest.mark.parametrize("sample", [1 << 16, 200])
def test_trees_equal_a_plain_booster(spark, monkeypatch, sample):
    from tallywatch.models import boosting as B

    monkeypatch.setattr(B, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(B, "CUT", 2)
    rng = np.random.default_rng(11)
    n = 1000
    x = np.stack([rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.integers(0, 2, n), rng.normal(size=n)], axis=1)
    x[rng.random(n) < 0.1, 3] = np.nan
    y = (x[:, 0] + np.where(np.isnan(x[:, 3]), 1, x[:, 3] * x[:, 2]) + rng.normal(size=n) > 1).astype(int)
    frame = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "k int, a double, b double, c double, d double, isFraud int")
    rules, weights = B.Rules(leaves=9, least_rows=20), (0.7, 1.9)
    model = B.fit_trees(frame.repartition(3), ["a", "b", "c", "d"], weights, 5, rules)
    raw, leaves = plain_booster(x, y, weights, 5, rules)
    got = frame.select("k", "a", "b", "c", "d")
    scores = {r["k"]: r["p"] for r in es.score(model, got, "p").select("k", "p").collect()}
    assert [scores[i] for i in range(n)] == pytest.approx((1 / (1 + np.exp(-raw))).tolist(), abs=1e-9)
    for tree, expected in zip(model.trees, leaves):
        held = B.leaves_of(B.codes_of(list(x.T), model.edges), tree)
        assert sorted(tuple(np.flatnonzero(held == v).tolist()) for v in np.unique(held)) == expected


def test_a_hundred_thousand_rows_take_a_round_or_two_a_tree(spark, monkeypatch):
    """Labels that no feature explains: a sample of fewer rows foresees no such splits, and a tree takes a round per level."""
    from tallywatch.models import boosting as B

    rounds, counted = [], B._counted
    monkeypatch.setattr(B, "_counted", lambda *a: rounds.append(1) or counted(*a))
    frame = spark.range(0, 100_000, 1, 4).selectExpr(
        "CAST(pmod(xxhash64(id, 1), 5000) AS DOUBLE) AS a", "CAST(pmod(xxhash64(id, 2), 5000) AS DOUBLE) AS b", "CAST(id % 41 = 0 AS INT) AS isFraud"
    )
    model = B.fit_trees(frame, ["a", "b"], (0.5, 20.5), 3)
    assert len(model.trees) == 3 and len(rounds) <= 6


def test_more_rows_than_the_sample_take_few_rounds_and_give_the_same_trees(spark, monkeypatch):
    """A tenth of the rows foresees no split on noise; small leaves then come to the driver whole."""
    from tallywatch.models import boosting as B

    rounds, counted = [], B._counted
    monkeypatch.setattr(B, "_counted", lambda *a: rounds.append(1) or counted(*a))
    frame = spark.range(0, 20_000, 1, 4).selectExpr(
        "CAST(pmod(xxhash64(id, 1), 5000) AS DOUBLE) AS a", "CAST(pmod(xxhash64(id, 2), 5000) AS DOUBLE) AS b", "CAST(id % 41 = 0 AS INT) AS isFraud"
    )
    whole = B.fit_trees(frame, ["a", "b"], (0.5, 20.5), 3)
    rounds.clear()
    monkeypatch.setattr(B, "SAMPLE_ROWS", 2000)
    part = B.fit_trees(frame, ["a", "b"], (0.5, 20.5), 3)
    assert len(part.trees) == 3 and len(rounds) <= 9
    codes = B.codes_of(list(frame.toPandas()[["a", "b"]].to_numpy().T), whole.edges)
    for one, other in zip(whole.trees, part.trees):
        assert one.value[B.leaves_of(codes, one)] == pytest.approx(other.value[B.leaves_of(codes, other)], abs=1e-9)


@pytest.mark.parametrize("fetched", [0, 600])
def test_leaves_too_large_for_the_driver_are_counted_in_place(spark, monkeypatch, fetched):
    from tallywatch.models import boosting as B

    rows = spark.range(0, 3000, 1, 5).selectExpr(
        "IF(id % 9 = 0, NULL, CAST(pmod(xxhash64(id, 1), 997) AS DOUBLE)) AS a", "CAST(pmod(xxhash64(id, 2), 3) AS DOUBLE) AS b",
        "CAST(pmod(xxhash64(id, 3), 997) + IF(id % 9 = 0, 700, pmod(xxhash64(id, 1), 997)) > 1200 AS INT) AS isFraud",
    )
    whole = B.fit_trees(rows, ["a", "b"], (0.8, 1.3), 4, B.Rules(least_rows=20))
    for name, value in (("SAMPLE_ROWS", 300), ("FETCHED_ROWS", fetched), ("BLOCK_ROWS", 250), ("CUT", 2)):
        monkeypatch.setattr(B, name, value)
    part = B.fit_trees(rows, ["a", "b"], (0.8, 1.3), 4, B.Rules(least_rows=20))
    codes = B.codes_of(list(rows.toPandas()[["a", "b"]].to_numpy().T), whole.edges)
    for one, other in zip(whole.trees, part.trees):
        assert one.value[B.leaves_of(codes, one)] == pytest.approx(other.value[B.leaves_of(codes, other)], abs=1e-9)


def test_trees_without_a_split_or_rows(spark):
    from tallywatch.models import boosting as B

    same = spark.range(300).selectExpr("1D AS a", "CAST(id % 2 AS INT) AS isFraud")
    model = B.fit_trees(same, ["a"], (1.0, 1.0), 5)
    assert len(model.trees) == 1 and es.score(model, same).where("score <> 0.5").count() == 0
    none = B.fit_trees(same.limit(0), ["a"], (1.0, 1.0), 5)
    assert none.trees == [] and es.score(none, same).where("score <> 0.5").count() == 0


def test_weights_sum_to_rows(parts):
    weighted, rows = scaling.with_class_weight(parts["TRAIN"])
    assert weighted.selectExpr("SUM(weight)").first()[0] == pytest.approx(rows) and rows == parts["TRAIN"].count()


def test_scaled_columns_have_unit_population_deviation(parts):
    train = parts["TRAIN"]
    rows = scaling.scaler(train, S.CONTINUOUS_FEATURES).transform(train)
    for name in S.CONTINUOUS_FEATURES:
        mean, std = rows.selectExpr(f"AVG({name}_z)", f"stddev_pop({name}_z)").first()
        assert abs(mean) < 1e-9 and std == pytest.approx(1)
    constant = train.selectExpr("0.5D AS c")
    assert scaling.scaler(constant, ["c"]).transform(constant).selectExpr("MAX(abs(c_z))").first()[0] == 0


def test_logistic_matches_newton(parts):
    train = parts["TRAIN"]
    model = es.fit_logistic(train, S.CONTINUOUS_FEATURES, S.BASELINE_BINARY)
    frame = scaling.scaler(train, S.CONTINUOUS_FEATURES).transform(scaling.with_class_weight(train)[0]).toPandas()
    x = frame[[f"{c}_z" for c in S.CONTINUOUS_FEATURES] + S.BASELINE_BINARY].to_numpy(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y, w = frame["isFraud"].to_numpy(float), frame["weight"].to_numpy(float)
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1])
    penalty[-1, -1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + penalty, gradient)
    assert model.coefficients == pytest.approx(beta[:-1], abs=1e-8) and model.passes < 20
    assert model.intercept == pytest.approx(beta[-1], abs=1e-8)


def test_saved_champion_scores_alike(spark, parts, champion, tmp_path):
    again = load_trees(spark, champion.save(spark, str(tmp_path / "m")))
    key = lambda m: [(r["transaction_id"], r["score"]) for r in es.score(m, parts["TEST"]).orderBy("transaction_id").collect()]
    scores = key(champion)
    assert key(again) == scores and all(0 <= s <= 1 for _, s in scores)


def test_guard_stops_leaking_columns(parts):
    from tallywatch.operators.quality import LeakageError

    with pytest.raises(LeakageError):
        es.fit_boosted_trees(parts["TRAIN"].selectExpr("*", "1 AS newbalanceOrig"), iterations=1)


def test_importance(parts, champion, spark):
    rows = importance.permutation_importance(champion, parts["VALIDATION"], repeats=2).collect()
    assert {r["Feature"] for r in rows} == set(S.CHAMPION_FEATURES)
    again = importance.permutation_importance(champion, parts["VALIDATION"], repeats=2).collect()
    assert [r["Importance_Mean"] for r in rows] == pytest.approx([r["Importance_Mean"] for r in again])
    one_class = parts["VALIDATION"].where("isFraud = 0")
    assert all(r["Importance_Mean"] is None for r in importance.permutation_importance(champion, one_class, repeats=1).collect())
    assert 0 < importance.seeded_sample(parts["TEST"], 10).count() < parts["TEST"].count()


def test_importance_maps_are_permutations():
    for n in (1, 2, 7, 12, 1000):
        for a, b in importance.affine_maps(n, 5, 1):
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_missing_features_are_kept(parts):
    holes = parts["TRAIN"].selectExpr("*", "IF(transaction_id % 50 = 0, NULL, log_amount) AS amount_or_null").drop("log_amount").withColumnRenamed("amount_or_null", "log_amount")
    trees = es.fit_boosted_trees(holes, iterations=2)
    assert es.score(trees, holes).where("score IS NULL").count() == 0
    line = es.fit_logistic(holes, S.CONTINUOUS_FEATURES, S.BASELINE_BINARY, 5)
    scored = es.score(line, holes)
    assert scored.where("score IS NULL").count() == 0 < holes.where("log_amount IS NULL").count()


def test_third_label_value_raises(spark):
    frame = spark.createDataFrame([(0,), (1,), (2,)], "isFraud int")
    with pytest.raises(ValueError):
        scaling.with_class_weight(frame)
    with pytest.raises(ValueError):
        es.fit_logistic(frame.selectExpr("*", "1D AS x"), ["x"], [])


def test_stress_rows_and_pivot(parts, spark):
    result = stress.stress_test(*parts.values(), 20, list(S.FEATURE_SETS)[:2])
    delta = {r["Model"]: r["F2_Delta_vs_A"] for r in delta_vs_baseline(result.comparison).collect()}
    assert delta[S.BASELINE_MODEL] == 0
    wide = {r["Feature"]: r for r in coefficient_pivot(result.coefficients).collect()}
    assert wide["binary__origin_zero_before_flag"][S.CHALLENGER_MODEL] is None
    assert wide["continuous__log_amount"][S.BASELINE_MODEL] is not None
    alone = es.fit_logistic(parts["TRAIN"], *S.FEATURE_SETS[S.CHALLENGER_MODEL][:2])
    assert result.models[S.CHALLENGER_MODEL].coefficients == pytest.approx(alone.coefficients, abs=1e-8)


def test_regression_without_rows_or_with_one_class(parts):
    with pytest.raises(ValueError):
        es.fit_logistic(parts["TRAIN"].where("FALSE"), ["log_amount"], [])
    one = es.fit_logistic(parts["TRAIN"].where("isFraud = 0"), ["log_amount"], ["type_transfer_flag"], 60)
    assert es.score(one, parts["TEST"]).where("score > 1e-3 OR score IS NULL").count() == 0


def test_saved_regression_scores_alike(parts, tmp_path):
    model = es.fit_logistic(parts["TRAIN"], S.CONTINUOUS_FEATURES, S.BASELINE_BINARY)
    again = es.load_model(es.save_model(model, str(tmp_path / "r")))
    key = lambda m: [(r["transaction_id"], r["score"]) for r in es.score(m, parts["TEST"]).orderBy("transaction_id").collect()]
    assert key(again) == key(model)
