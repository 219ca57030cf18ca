import random
import re
import string

from tallywatch.llm import lines as L
from text_fixtures import docs_of  # noqa: F401 (a fixture)

SPLIT = re.compile("[ \t\n\x0b\x0c\r" + re.escape(string.punctuation) + "]+")


def brute_force(docs, percent=80):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0]))
    seen, gone = [], set()
    for i, text in order:
        for k, line in enumerate((text if text is not None else "").split("\n")):
            words = {w for w in SPLIT.split(line.lower()) if w}
            if words:
                if any(100 * len(words & o) >= percent * len(words | o) for o in seen):
                    gone.add((i, k))
                seen.append(words)
    return gone


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 20, 40]))] for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = f"n{rng.randrange(50)}"
            lines.append(rng.choice(["", "- ", "WORD "]) + " ".join(line) + rng.choice(["", ".", " !!"]))
        docs.append((i * 7 % 41, "\n".join(lines)))
    return docs


def test_removed_lines_match_all_pairs(spark, docs_of):
    docs = make(4) + [(100, None), (101, ""), (102, "\n\n"), (103, "!!!\n???\n!!!"), (104, "one"), (105, "One."), (None, "two\none")]
    got = {(r["doc_id"], r["line"]) for r in L.repeated_lines(docs_of(docs)).collect()}
    assert got == brute_force(docs)


def test_few_pivots_lose_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(L, "PIVOTS", 1)
    docs = make(5)
    assert {(r["doc_id"], r["line"]) for r in L.repeated_lines(docs_of(docs)).collect()} == brute_force(docs)


def test_documents_are_cut(spark, docs_of):
    docs = docs_of([(1, "alpha beta gamma\nown line here"), (2, "Alpha, beta gamma!\nsomething else again"), (3, "alpha beta gamma"), (4, ""), (5, None), (6, "!!")])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in L.remove_lines(docs).collect()}
    assert out == {1: ("alpha beta gamma\nown line here", 30), 2: ("something else again", 20), 4: ("", 0), 5: (None, None), 6: ("!!", 2)}
    assert L.remove_lines(docs).columns == docs.columns
    assert L.remove_lines(docs.limit(0)).count() == 0


def test_repeated_rows(spark, docs_of):
    docs = docs_of([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "delta epsilon")])
    assert L.repeated_lines(docs).count() == 0


def test_group_of_near_copies(spark, docs_of):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"x{rng.randrange(60)}" for w in base)) for i in range(120)]
    assert {(r["doc_id"], r["line"]) for r in L.repeated_lines(docs_of(docs)).collect()} == brute_force(docs)


def test_pairs_follow_the_size_of_a_group(spark, docs_of, monkeypatch):
    made = []
    verified = L._verified
    monkeypatch.setattr(L, "_verified", lambda docs, firsts, pairs, percent: made.append(pairs.count()) or verified(docs, firsts, pairs, percent))
    rng = random.Random(7)
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(w if rng.random() > 0.07 else f"x{rng.randrange(40)}" for w in base)) for i in range(500)]
    assert {(r["doc_id"], r["line"]) for r in L.repeated_lines(docs_of(docs)).collect()} == brute_force(docs)
    assert made[-1] < len(docs) / 2, made  # left to the lists of prefix words


def test_words_are_coded_once(spark, docs_of):
    docs = docs_of(["alpha beta\ngamma", None])
    plan = L._lines(docs, L._word_classes(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(lambda w") == 1


def test_words_are_parted_as_by_classes(spark):
    text = "".join(f"a{chr(c)}" for c in [*range(1, 400), 0x2028, 0x3000, 0xFF0C]) + "]]b\\c^d-e"
    row = spark.createDataFrame([(text,)], "x string").selectExpr(
        f"split(x, {L._PARTS}) AS got", "split(x, '[\\\\s\\\\p{Punct}]+') AS want"
    ).first()
    assert row["got"] == row["want"] and "" not in row["got"]


def test_rounds_read_only_what_bitmaps_let_through(spark, docs_of, monkeypatch):
    plans, rows, staged = {}, [], L.Stages.stage

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = staged(self, df, name)
        if name == "crowd":
            rows.append(out.count())
        return out

    monkeypatch.setattr(L.Stages, "stage", spy)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(w if rng.random() > 0.07 else f"x{rng.randrange(40)}" for w in base)) for i in range(300)]
    docs += [(1000 + i, " ".join(f"y{rng.randrange(3000)}" for _ in range(20)) + "\nshort line") for i in range(200)]
    assert {(r["doc_id"], r["line"]) for r in L.repeated_lines(docs_of(docs)).collect()} == brute_force(docs)
    assert "getbit" in plans["homes"]  # lines are thinned out before they are joined by their node
    assert rows and all(a >= b for a, b in zip(rows, rows[1:]))  # later rounds read no more than the first's lists


def test_words_are_counted_by_the_parts_that_code_them(spark, docs_of):
    plan = L._word_classes(docs_of(["a b", "c, d"]))._jdf.queryExecution().toString()
    assert "Punct" not in plan
