import numpy as np
import pytest

from tallywatch.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<double>, label int, slot string, score int, rank string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute_force(rows, divisor=100, k=5):
    whole = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(256.0 * x)) for x in v]
        if sum(x * x for x in v) < 2**63:
            whole.append((i, v, label))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in whole:
        if i % divisor:
            continue
        scored = sorted((-score(v, w), j, other) for j, w, other in whole if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            p = -p
            fits = [(-n, m) for n, m, other in scored if other != label and 80 * p <= 100 * -n <= 100 * p]
            out += [(i, j, r + 1, m, p, n) for r, (n, m) in enumerate(fits[:k])]
    return sorted(out)


def mined(frame, divisor=100, **options):
    return sorted(tuple(r) for r in N.hard_negatives(frame, f"vec_id % {divisor} = 0", **options).collect())


@pytest.mark.parametrize("n, k, m", [(1, 1, 1), (13, 64, 29), (130, 33, 257), (64, 64, 64), (17, 0, 5)])
def test_product(n, k, m):
    rng = np.random.default_rng(1)
    for most in (300, 2**29):
        a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
        assert (N.strassen(a, b) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 7, 900), rng.integers(-4, 4, 900), rng.permutation(900)])
    heaps = N.Heaps(7, 5)
    for part in np.array_split(x, 40, axis=1):
        heaps.add(*part)
        if part[0, 0] % 2:
            heaps.merge()
    expected = sorted((s, -v, i) for s, v, i in x.T.tolist())
    first = [e for n, e in enumerate(expected) if n < 5 or expected[n - 5][0] != e[0]]
    assert [(s, -v, i) for s, v, i in heaps.merge().T.tolist()] == first


@pytest.mark.parametrize("group_bytes", [1 << 24, 2_000])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(N, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(N, "CANDIDATE_TILE", 64)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 13))
    rows = [(i, (centres[(i // 2) % 3] + rng.standard_normal(13)).tolist(), int(rng.integers(0, 4))) for i in range(600)]
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(60)]  # many equal vectors
    rows += [rows[100], rows[7], (2000, [1.0, 2.0], 1), (2100, [], 2)]
    got = mined(frame_of(spark, rows).repartition(5), 20)
    assert got and got == brute_force(rows, 20)


def test_rows_that_take_no_part_and_empty_tables(spark):
    v = [1.0, 0.5]
    rows = [(0, v, 1), (1, v, 1), (2, [0.9, 0.5], 2), (3, None, 2), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (None, v, 2), (8, v, None), (100, [1e9, 1e9], 1), (200, [-1.0, 0.0], 7), (9, v, 2)]
    got = mined(frame_of(spark, rows))
    assert got == brute_force(rows) == [(0, 1, 1, 9, 81920, 81920), (0, 1, 2, 2, 81920, 75264)]
    assert mined(frame_of(spark, [])) == []
    assert mined(frame_of(spark, rows[:2])) == []
    zero = [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2), (3, [-1.0], 2)]  # a window of one score
    assert mined(frame_of(spark, zero)) == brute_force(zero) != []


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3) * 4e6 + 4e6).tolist(), i % 2) for i in range(60)]
    assert mined(frame_of(spark, rows), 20) == brute_force(rows, 20)
