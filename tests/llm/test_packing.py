import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallywatch.llm import packing as P
from text_fixtures import docs_of  # noqa: F401 (a fixture)

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello<|endoftext|> world, it's we'll DON'T.", "ΣΑΣ ΣΑΣ. Ǆ İI ﬁ été", "a b\x1cc\x85d", "", "  ", "«über»...! x", "a1b2 c_d __x__ 'tis", None, "ÿŸ ßẞ µº ª\r\n\t."]


def test_ids_are_those_of_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS]
    want = [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # with an empty and with a filled cache
        assert [np.frombuffer(x, "<u4").tolist() for x in P.encode(texts, PATH, 2)] == want


def brute_force_line(tokens, weights, window):
    """Serve queues round by round, token by token counts."""
    left, line = list(tokens), []
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        share = P.shares([weights[i] for i in active])
        served, r = [0] * len(active), 0
        start = [left[i] for i in active]
        while all(left[i] for i in active):
            r += 1
            for k, i in enumerate(active):
                due = min(start[k], r * window * share[k] >> P.SHARE_BITS) - served[k]
                line += [i] * due
                served[k] += due
                left[i] -= due
    return line


@pytest.mark.parametrize("tokens,weights", [([50, 7, 0, 120], [5, 1, 1, 3]), ([1, 1], [1, 1000]), ([40], [1]), ([0, 0], [1, 1])])
def test_places_match_a_round_by_round_robin(tokens, weights):
    window = 16
    plan = P.phases(tokens, weights, window)
    line = np.full(sum(tokens), -1)
    for q, n in enumerate(tokens):
        if n:
            sizes = np.array([x for x in (n // 3, n - n // 3) if x])
            begin = np.cumsum(sizes) - sizes
            doc, first, length, at = P.place(q, begin, sizes, plan, window)
            for d in range(len(sizes)):
                own = doc == d
                assert first[own][0] == 0 and (np.cumsum(length[own])[:-1] == first[own][1:]).all() and length[own].sum() == sizes[d]
            for f, m, p in zip(first, length, at):
                assert p % window + m <= window and (line[p : p + m] == -1).all()
                line[p : p + m] = q
    assert line.tolist() == brute_force_line(tokens, weights, window)


def test_pieces_restore_documents(spark, docs_of):
    rows = TEXTS + ["word " * 400] * 3 + [(None, "no id"), (3, "twice"), (3, "twice")]
    rows = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
    docs = docs_of(rows).unionByName(docs_of([(100, "other source " * 50)], "b")).unionByName(docs_of([(101, "null source")], None))
    pieces = P.pack(docs, PATH, window=64).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t for _, t in rows] + ["other source " * 50, "null source"]
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert pieces.length.sum() == total
    ordered = pieces.sort_values(["sequence_id", "offset"])
    place = ordered.sequence_id * 64 + ordered.offset
    assert (place.values == np.cumsum(ordered.length.values) - ordered.length.values).all()
    for i in (0, 6, 10):
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [2]
    windows = pieces[pieces.sequence_id < pieces.sequence_id.max()].groupby(["sequence_id", "queue"]).length.sum().unstack(fill_value=0)
    assert (windows.max() - windows.min()).max() <= 4  # every full window holds the target shares


def test_targets_set_the_mixture(spark, docs_of):
    docs = docs_of(["a b c d " * 40], "x").unionByName(docs_of([(9, "e f g h " * 40)], "y"))
    pieces = P.pack(docs, PATH, window=32, targets={"x": 3.0}).toPandas()
    first = pieces[pieces.sequence_id == 0].groupby("queue").length.sum().to_dict()
    assert first == {0: 24, 1: 8}


def test_empty_table(spark, docs_of):
    assert P.pack(docs_of([]), PATH).count() == 0


def test_every_source_has_a_queue(spark, docs_of):
    """More sources than 64, equal in tokens: each is in every full window with its share."""
    rows = [(i, "a b c d e f g " * 3, f"s{i % 100}" if i % 100 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pieces = P.pack(docs, PATH, window=200).toPandas()
    assert pieces.queue.nunique() == 100
    windows = pieces[pieces.sequence_id < pieces.sequence_id.max()].groupby(["sequence_id", "queue"]).length.sum().unstack(fill_value=0)
    tokens = pieces.groupby("queue").length.sum()
    due = 200 * tokens / tokens.sum()
    assert len(windows) > 30 and ((windows - due).abs() <= 4).all().all() and windows.shape[1] == 100
