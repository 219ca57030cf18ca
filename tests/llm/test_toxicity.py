import random
import tracemalloc

import numpy as np
import pyarrow as pa
from zlib import crc32

from tallywatch.llm import toxicity as T
from tallywatch.llm.common import worker_cache
from text_fixtures import docs_of  # noqa: F401 (a fixture)


def brute_force_segments(scores):
    """All maximal segments by their definition: split the best one off, go on left and right."""
    def best(lo, hi):
        top = (0.0, None)
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > top[0] + 1e-12 or (top[1] and abs(s - top[0]) <= 1e-12 and (b - a) < (top[1][1] - top[1][0])):
                    top = (s, (a, b))
        if not top[1]:
            return []
        a, b = top[1]
        return best(lo, a) + [(a, b)] + best(b, hi)

    return best(0, len(scores))


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(60):
        scores = np.array([rng.uniform(-2, 1.5) for _ in range(rng.randrange(1, 25))])
        got = [(a, b) for a, b, _ in T.segments(scores)]
        assert got == brute_force_segments(scores.tolist())
    assert T.segments(np.array([-1.0, -2.0])) == []


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vileword", "nastyword", "Badword!!"], k=4)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_table_of_scores_is_built_in_little_memory():
    rng = np.random.default_rng(4)
    tokens = np.unique(rng.integers(0, 2**63, 1 << 20, dtype=np.uint64) * np.uint64(2))
    model = T.Model(tokens, rng.normal(size=len(tokens)), 0.0, 0.0, np.zeros(3))
    tracemalloc.start()
    table = T._Scores(model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * len(tokens)  # copies of 16 bytes a token and places of 16
    some = rng.integers(0, len(tokens), 1000)
    assert (table.of(tokens[some]) == model.scores[some]).all()
    assert not table.of(tokens[some] + np.uint64(1)).any()  # only even hashes are there


def test_workers_hold_one_table_and_a_megabyte_of_text(monkeypatch):
    tokens = np.array([3, 1 << 62, 2**64 - 2], np.uint64)
    model = T.Model(tokens, np.array([1.0, 2.0, 3.0]), 0.0, 0.0, np.zeros(3))
    table = T._Scores(model)
    assert table.tokens is model.tokens and table.scores is model.scores  # the broadcast arrays, not copies
    assert table.of(np.array([0, 3, 4, 1 << 62, 2**64 - 2, 2**64 - 1], np.uint64)).tolist() == [0, 1, 0, 2, 3, 0]
    assert T._Scores(T.Model(tokens[:0], np.zeros(0), 0.0, 0.0, np.zeros(3))).of(tokens).tolist() == [0, 0, 0]
    texts = ["one word " * 30_000, None, "", "short", "x" * (3 << 20), "vile word"] + ["a few words " * 5_000] * 60
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    held, lowered = [], T.lowered
    monkeypatch.setattr(T, "lowered", lambda column: held.append(lowered(column)) or held[-1])
    shared = type("Shared", (), {"value": (model.tokens, model.scores)})
    out = list(T._score_rows(shared, model.parts()[2:], "text")(iter([batch, batch.slice(0, 0)])))
    assert sum(held, []) == lowered(batch.column("text"))  # every text once, whole and in order
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(len(x) == 1 or sum(map(len, x)) <= 1 << 20 for x in held)


def test_workers_give_back_what_packing_left():
    worker_cache("packing")["path"] = {"word": b"ids"}
    batch = pa.RecordBatch.from_pydict({"text": ["some words", None]})
    assert sum(b.num_rows for b in T._sketch_rows(iter([batch]))) == 2
    assert not worker_cache("packing") and worker_cache("powers")


def test_held_out_rows_are_told_apart(spark, docs_of):
    rows, labels = corpus(600)
    docs = docs_of(rows + [(1000, None), (1001, ""), (None, "no id"), (0, rows[0][1])])
    frame = spark.createDataFrame(labels + [(None, 1, 1), (2000, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    out = T.score(docs, frame).collect()
    assert len(out) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r for r in out}
    for i, _, toxic in labels:
        assert by[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0)
        if by[i]["held_out"]:
            assert by[i]["predicted"] == toxic
            assert bool(by[i]["passages"]) == bool(toxic)
    kept = T.clean_documents(docs, frame)
    assert kept.columns == docs.columns and kept.count() < 604


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in T.score(docs_of(["a", None]), none).collect()} <= {0}
    assert T.score(docs_of([]), none).count() == 0


def test_inflected_forms_share_evidence_in_a_small_sample(spark, docs_of):
    """No toxic form stands in more than a few texts: only what the forms have in common tells."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(4, 9))) for _ in range(30)]
        if i % 6 == 0:
            words[10:10] = [f"šmuz{''.join(rng.choices('rstuvwx', k=4))}" for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = [r for r in T.score(docs_of(rows), frame).collect() if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["doc_id"] % 6 == 0]
    assert toxic and all(toxic) and not any(r["predicted"] for r in held if r["doc_id"] % 6)
