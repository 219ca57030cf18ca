import itertools
import random
import re

import numpy as np
import pytest

from tallywatch.llm import jaccard as J
from text_fixtures import docs_of  # noqa: F401 (a fixture)


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_force(docs, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("percent,size", [(85, 4), (80, 5)])
def test_components_match_all_pairs(spark, docs_of, percent, size):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "   ", "one", "one two", "One TWO", "a b c d", "a b c d e f g h i", "a b c d e f g h i j"]
    for n in (9, 14, 30, 60, 150, 400):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts += [edited(base, rng.randrange(1 + n // 25 + 1), rng) for _ in range(12)]
            texts += [" ".join(base)] * 2
    docs = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    assert len({i for i, _ in docs}) == len(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_documents(docs_of(docs), size, percent).collect()}
    want = brute_force(docs, size, percent)
    assert got == want
    kept = {r["doc_id"] for r in J.first_of_each(docs_of(docs), size, percent).collect()}
    assert kept == {c for _, c in want.values()}


def test_keys_of_similar_sets_meet():
    """Whatever the boundary, two similar sets share a key, if they are not equal."""
    rng = np.random.default_rng(1)
    rank = rng.integers(0, 5, 1 << J.BUCKET_BITS).astype(np.uint8)
    for n in (6, 7, 13, 20, 40, 100, 333):
        for boundary in (0, 10, 19, 40, 104, 400):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for cut in range(0, n // 6 + 1):
                for extra in range(0, n // 6 + 1):
                    b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                        assert np.intersect1d(J._keys(a, rank, 85, boundary), J._keys(b, rank, 85, boundary)).size


def test_repeated_rows_null_ids_and_empty(spark, docs_of):
    text = "a b c d e f g h i j k l m n o p"
    rows = J.similar_documents(docs_of([(5, text), (5, text), (2, text + " q"), (None, text)])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == [(2, 2), (5, 2), (5, 2), (None, 2)]
    assert J.similar_documents(docs_of([])).count() == 0
    assert J.similar_documents(docs_of([None, ""])).count() == 2


def test_boundary_follows_cost():
    assert J.choose_boundary([], 85) == 0
    assert J.choose_boundary([(20, 1000)], 85) >= 20  # three pairs of few shingles are cheap
    assert J.choose_boundary([(400, 1000)], 85) < 400


def test_a_pair_is_made_in_one_of_the_lists_that_hold_it():
    import pyarrow as pa

    def made(key, sketches):
        rows = len(sketches)
        return J._pair_block(85)(pa.table({
            "key": [key] * rows, "node": list(range(1, rows + 1)), "n": [20] * rows, "label": list(range(1, rows + 1)), "share": [0] * rows,
            "low": [0] * rows, "high": [0] * rows, "profile": [bytes([20] + [0] * 255)] * rows, "sketch": pa.array(sketches, pa.list_(pa.int64())),
        })).to_pylist()

    assert made(5, [[5, 9], [5, 9]]) == [{"pivot": 1, "node": 2}] and made(9, [[5, 9], [5, 9]]) == []
    assert made(9, [[3, 9], [5, 9]]) == [{"pivot": 1, "node": 2}]  # no earlier list holds both
    assert made(99, [[5, 9], [5, 9], []]) == [{"pivot": 1, "node": 3}, {"pivot": 2, "node": 3}]


def test_members_without_a_partner_leave_their_list(spark, monkeypatch):
    """Unrelated texts that meet in a list make no rows behind it; near ones stay, over all blocks of a list."""
    monkeypatch.setattr(J, "BLOCK_NODES", 7)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = {i: rng.integers(0, 2**63, 300, dtype=np.uint64) for i in range(60)}  # unrelated
    sets |= {100 + i: np.concatenate([base[: 300 - i], rng.integers(0, 2**63, i, dtype=np.uint64)]) for i in range(0, 12, 2)}
    sets[200] = base[:200]  # too small
    rows = [(5, i, len(s), *J._parity(np.unique(s)).tolist()) for i, s in sets.items()] + [(6, 100, 300, *J._parity(base).tolist())]
    lists = spark.createDataFrame(rows, "key bigint, node bigint, n bigint, bits0 bigint, bits1 bigint, bits2 bigint, bits3 bigint")
    kept = [tuple(r) for r in J._with_partner(lists, 85).collect()]
    assert sorted(kept) == [(5, i, 300) for i in range(100, 112, 2)]


def test_parity_differs_by_no_more_than_the_members():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)]))
        bits = int(np.bitwise_count((J._parity(a) ^ J._parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_texts_become_objects_a_part_at_a_time(monkeypatch):
    """A worker holds about a megabyte of a batch's texts as Python objects, not the whole batch."""
    import pyarrow as pa

    held = []
    lowered = J.lowered
    monkeypatch.setattr(J, "lowered", lambda c: held.append(c.nbytes) or lowered(c))

    class Rank:
        value = np.zeros(1 << J.BUCKET_BITS, np.uint8)

    texts = [" ".join(f"w{i}x{j}" for j in range(30_000)) for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": texts, "task": pa.array([0] * 30, pa.int32())})
    assert sum(b.num_rows for b in J._node_rows(4)(iter([batch])) if b.column("block").null_count) == 30
    assert len({x for b in J._key_rows(4, 85, 0, Rank, None)(iter([batch])) for x in b.column("node").to_pylist()}) == 30
    assert len(held) > 2 and max(held) < 3 << 20
