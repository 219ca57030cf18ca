import numpy as np
import pytest

from tallywatch.llm import neighbours as N


def test_quantile():
    assert N.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert N.chi_square_quantile(0.99, 16) == pytest.approx(31.99993, abs=1e-4)


def exact(ids, x, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 5 == 0:
            s = x @ x[q]
            s[q] = -np.inf
            out[ids[q]] = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((700, 24)) * rng.uniform(0.5, 2, (700, 1))
    ids = np.arange(700) * 1
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, label int")
    got = N.nearest(frame, "vec_id % 5 = 0", k=10).toPandas()
    hits = 0
    for q, best in exact(ids, x, 10).items():
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and (np.diff(own.score) <= 1e-12).all()
        assert np.allclose(own.score, x[own.vec_id] @ x[q], rtol=1e-12)
        hits += len(set(ids[best]) & set(own.vec_id))
    assert hits >= 0.9 * 10 * 140


def test_ties_bad_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (10, [float("nan"), 1.0]), (15, [None, 1.0]), (20, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in N.nearest(frame, "vec_id % 5 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert N.nearest(frame.limit(0), "vec_id % 5 = 0").count() == 0


def test_equal_vectors_keep_the_order_of_ids(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 24))
    x[rng.choice(3000, 300, replace=False)] = x[17]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = N.nearest(frame, "vec_id % 4 = 0").orderBy("query_id", "rank").toPandas()
    same = set(np.flatnonzero((x == x[17]).all(axis=1)).tolist())
    for q, own in got.groupby("query_id"):
        pairs = list(zip((-own.score).tolist(), own.vec_id.tolist()))
        assert pairs == sorted(pairs)
        assert len({s for s, i in pairs if i in same}) <= 1
