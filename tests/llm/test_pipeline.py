import random

import corpus_pipeline as P
import pytest
from test_decontam import words
from test_jaccard import shingle_set
from test_lines import brute_force as repeated

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of small tables with planted copies, passages and toxic texts."""
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    item = say(30)
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        text = say(60)
        if toxic:
            text = text.replace(" ", " vileword badword ", 2) + " vileword badword"
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    base = say(80).split()
    for k in range(4):  # copies with another word each
        docs.append((400 + k, " ".join(base[:40] + [f"edit{k}"] + base[41:])))
    docs += [(500, say(40) + " " + item[: len(item) // 2] + " " + say(20)), (501, say(30) + "\n" + say(30)), (502, None), (503, ""), (504, "short")]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages_against_brute_force(spark, folder):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = [docs]
    for name, function in P.STAGES[:-1]:
        kept.append(function(spark, kept[-1], path))
        assert kept[-1].columns == columns, name
    raw, clean, cut, one, last = map(texts, kept)
    assert set(clean) == {i for i, t in raw.items() if "vileword" not in (t or "")}
    gone = repeated(list(clean.items()))
    for i, text in clean.items():
        lines = (text or "").split("\n")
        rest = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert cut.get(i, "") == (text if len(rest) == len(text or "") else rest) or text is None
    assert {401, 402, 403}.isdisjoint(cut)  # near copies of one line go with it
    sets = {i: shingle_set(t, 5) for i, t in cut.items()}
    assert set(one) == {i for i in sets if not any(j < i and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in sets)}
    want = words(item)
    hit = lambda t: any(words(t)[p : p + 10] == want[q : q + 10] for p in range(len(words(t)) - 9) for q in range(len(want) - 9))
    assert set(last) == {i for i, t in one.items() if not hit(t)} and 500 not in last
    packed = P.STAGES[-1][1](spark, kept[-1], path)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(last)


def test_run_and_registration(spark, folder):
    path, _ = folder
    assert entry_points.queries()["pipeline"] is P.run
    rows = P.run(spark, path).collect()
    assert len(P.STAGES) == 5 and rows and P.ORACLE_SQL is None
