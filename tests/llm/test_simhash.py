import random
import re

import numpy as np
import pytest
import xxhash
from text_fixtures import docs_of  # noqa: F401 (a fixture)

from tallywatch.llm import common, simhash as S


def plain_fingerprint(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_force(rows, radius=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, f"{p:016x}", least.get(x)) for (i, _), p, x in zip(rows, prints, label)), key=repr)


def found(frame):
    return sorted(((r["doc_id"], f"{r['print'] % 2**64:016x}", r["component_id"]) for r in S.near_duplicates(frame).collect()), key=repr)


def near_copies(n, seed, words=200):
    r = random.Random(seed)
    base = [r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(words)]
    for _ in range(n):
        own = list(base)
        own[r.randrange(words)] = f"z{r.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("tile", [4096, 7])
def test_components_against_brute_force(spark, docs_of, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    texts = [*near_copies(60, 1), *near_copies(30, 2), *[t for k in range(50) for t in near_copies(1, 100 + k, 40)]]
    texts += [None, "", " \t\n", "One", "one", "Two Words", "É É É", "é é é", "a b c", "A B\tC", "a b c d", "x " * 300]
    random.Random(3).shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(5, texts[0]), (5, texts[0]), (None, "one"), (None, "alone in the world")]
    assert found(docs_of(rows).repartition(4)) == brute_force(rows)


def test_very_long_text(spark, docs_of, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(400_000)) + " " + "q" * 3_000_000 + " end"
    whole = S.fingerprint(text, 3)
    assert whole == (plain_fingerprint(text), 400_000)
    monkeypatch.setattr(common, "_CHUNK", 10)
    assert S.fingerprint(text[:5000], 3) == (plain_fingerprint(text[:5000]), len(text[:5000].split()) - 2)
    assert [r["component_id"] for r in S.near_duplicates(docs_of([(2, text), (1, text)])).collect()] == [1, 1]


def test_tiles_hold_every_link():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    a, b = S.tile_links(base, near, 3)
    roots = dict(zip(a.tolist(), b.tolist()))
    assert all(roots[y] == roots.get(x, x) for x, y in zip(base.tolist(), near.tolist()))
    chain = np.array([(1 << k) - 1 for k in range(0, 64, 3)], np.uint64)  # each within reach of the next only
    a, b = S.tile_links(chain, None, 3)
    assert len(a) == len(chain) - 1 and set(b.tolist()) == {0}


def test_empty_table_and_first_of_each(spark, docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0
    kept = S.first_of_each(docs_of([(3, "a b c d"), (1, "A b c d"), (2, None), (None, None), (7, "other text of its own")]))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 2, 7, None]
    assert kept.columns == docs_of([]).columns
