import re

from tallywatch.llm import decontam as D
from text_fixtures import docs_of  # noqa: F401 (a fixture)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, window=10):
    out = {}
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit |= set(range(q, q + n))
                        names.add(str(name) if name is not None else "")
        out[i] = (len(w), len(hit), sorted(names))
    return out


def test_windows_short_items_and_repeats(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [
        (1, long), (2, "x " * 50 + long[:80]), (3, "Short ITEM here"), (4, None), (5, ""), (6, "one two three four five six seven eight nine ten eleven"),
        (7, "é ü " * 20), (8, "w3,w4;w5 w6 w7 w8 w9 w10 w11 w12"), (9, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (10, "a " * 100), (None, "short item"),
    ]
    items = [(1, long), (2, "short item"), (3, "one"), (4, None), (5, "---"), (6, "é ü é ü é"), (7, "a a a a a a a a a a a a"), (None, "nine ten"), (2, "short item")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.contamination(docs_of(docs), benchmark).collect()}
    assert found == brute_force(docs, items)
    kept = {r["doc_id"] for r in D.clean_documents(docs_of(docs), benchmark).collect()}
    assert kept == {i for i, (_, hit, _) in found.items() if not hit}


def test_repeated_rows_and_empty_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    rows = D.contamination(docs_of([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "other")]), benchmark).collect()
    assert sorted((r["n_words"], r["n_hit"]) for r in rows) == [(1, 0), (3, 3), (3, 3)]
    assert D.contamination(docs_of([]), benchmark).count() == 0
    rows = D.contamination(docs_of(["alpha"]), benchmark.limit(0)).collect()
    assert [(r["n_hit"], r["items"]) for r in rows] == [(0, [])]
