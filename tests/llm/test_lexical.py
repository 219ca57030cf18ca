import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from text_fixtures import docs_of  # noqa: F401 (a fixture)

from tallywatch.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = 0
            for t in own & set(c):
                df = sum(t in x for _, x in counted)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in L.search(docs, items, **options).collect()), key=repr)


def made(r, n, words=60):
    common, rare = [f"c{i}" for i in range(12)], [f"Ré{i}" for i in range(400)]
    return [" ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("group, postings", [(1 << 20, 1 << 21), (60, 200)])
def test_against_brute_force(spark, docs_of, monkeypatch, group, postings):
    monkeypatch.setattr(L, "GROUP_TERMS", group)
    monkeypatch.setattr(L, "POSTINGS", postings)
    r = random.Random(1)
    docs = [(1000 - i, t) for i, t in enumerate(made(r, 300))]
    docs += [(i, docs[7][1]) for i in range(2000, 2040)] + [docs[3], docs[3], (None, docs[5][1]), (None, None), (4000, ""), (4001, "?! -"), (4002, "C1;c2--C3\tc4 " * 50)]
    items = [*enumerate(made(r, 25, 40)), (3, "c1 c1 c2"), (None, "c1 Ré5"), (100, None), (101, " . "), (102, "nowhere"), (103, "c0 c1 c2 c3 c4")]
    benchmark = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id bigint, text string, term int, score double")
    assert found(docs_of(docs).repartition(5), benchmark) == brute_force(docs, items)
    assert found(docs_of(docs).repartition(3), benchmark, k=2) == brute_force(docs, items, 2)


def test_accumulators_are_limited_but_scores_exact():
    r = np.random.default_rng(1)
    n = 2000
    has = r.random((n, 6)) < np.array([0.01, 0.02, 0.05, 0.4, 0.7, 0.9])
    has[0, 0] = True
    weights = np.array([0, 6000, 5000, 3000, 300, 30, 3])
    times = r.integers(1, 4, (n, 6))
    lists = L.Postings(
        np.arange(n), np.zeros(n, bool), np.full(n, 40), has.sum(1), (np.nonzero(has)[1] + 1).astype(np.int32), times[has], weights, n, 40 * n
    )
    lists_best = lists.best(np.arange(1, 7), 10, 1)
    m = 100
    whole = (has * weights[1:] * ((10**9 * times) // (1000 * times + 8 * m))).sum(1)
    expected = np.lexsort((np.arange(n), -whole))[:10]
    doc, score = lists_best
    assert set(expected) <= set(doc) and (score == whole[doc]).all() and not lists.scores.any()


def test_long_texts_and_empty_tables(spark, docs_of):
    long = "alpha " * 700_000 + "omega " + "b" * 2_000_000
    docs = [(1, long), (2, "alpha omega"), (3, "beta")]
    items = [(1, "omega"), (2, "ALPHA"), (3, "b" * 2_000_000)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(docs_of(docs), benchmark) == brute_force(docs, items)
    assert found(docs_of([]), benchmark) == [] and found(docs_of(docs), benchmark.limit(0)) == []
    assert found(docs_of([(1, None)]), benchmark) == []
