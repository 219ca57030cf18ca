"""Named queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def _(spark, folder):
    from tallywatch.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue"
    )


# Positions are explicit: words of documents and items with their place, windows
# as joined words, a hit word as a place inside any matching window.
_OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)"""


@query("op10_decontamination", _OP10)
def _(spark, folder):
    from tallywatch.llm.decontam import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "CAST(size(items) AS BIGINT) AS n_items",
        "sha2(array_join(items, ','), 256) AS items_sha256", "n_hit > 0 AS contaminated",
    )


@query("op5_toxicity")
def _(spark, folder):
    from tallywatch.llm.toxicity import score

    scored = score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.selectExpr("doc_id", "held_out", "score", "predicted", "size(passages) AS n_passages")


# A conversation as the list of its turns; a shorter list that starts a longer one goes.
_OP2 = """
WITH c AS (
  SELECT conv_id, list(t ORDER BY turn) AS said, string_agg(r, '' ORDER BY turn) AS text
  FROM (SELECT DISTINCT conv_id, turn, role || chr(31) || text AS t, '<|' || role || '|>' || chr(10) || text || chr(10) AS r FROM conversations)
  GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, said, min(text) AS text, count(*) AS n_copies FROM c GROUP BY said)
SELECT conv_id, CAST(len(said) AS BIGINT) AS n_turns, n_copies, CAST(0 AS BIGINT) AS part, text FROM u
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.said[1] = u.said[1] AND len(b.said) > len(u.said) AND b.said[1:len(u.said)] = u.said)"""


@query("op2_chat", _OP2)
def _(spark, folder):
    from tallywatch.llm.chat import render

    return render(table(spark, folder, "conversations"))


def _op9() -> str:
    """Sentences and rules as in the operator, stated with lists."""
    from tallywatch.llm.licences import KEYWORDS, RULES, SENTENCES

    known = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{i}'" for i, p in SENTENCES)
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(RULES, 1):
        text = f"' {'  '.join(ids.split())} '"
        steps.append(
            f"s{k} AS (SELECT doc_id, ids, replace(rest, {text}, ' . ') AS rest, "
            f"CASE WHEN contains(rest, {text}) AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"s{k}"
    return rf"""WITH x AS (
  SELECT doc_id, list_filter(list_transform(list_filter(list_transform(list_filter(
      regexp_split_to_array(lower(coalesce(text, '')), '[\n\r]+|[.!?]+\s+'), lambda x: regexp_matches(x, '{KEYWORDS}')),
      lambda x: trim(regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), '[. ]+$', ''))), lambda x: x <> ''),
      lambda x: CASE {known} END), lambda x: x IS NOT NULL) AS ids FROM documents),
s0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS rest, CAST([] AS VARCHAR[]) AS found FROM x),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids, array_to_string(found, ' ') AS licences, CAST(len(found) AS BIGINT) AS n_licences FROM {last}"""


@query("op9_licences", _op9())
def _(spark, folder):
    from tallywatch.llm.licences import scan

    return scan(table(spark, folder, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", "array_join(sentence_ids, ' ') AS sentence_ids", "array_join(licences, ' ') AS licences",
        "CAST(size(licences) AS BIGINT) AS n_licences",
    )


@query("op3_surrogates")
def _(spark, folder):
    from tallywatch.llm.pii import replace_entities

    return replace_entities(table(spark, folder, "documents"), key="tallywatch")


# Shared shingles counted by an equi-join, components by a recursive walk.
_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], chr(32)) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


@query("op4_jaccard", _OP4)
def _(spark, folder):
    from tallywatch.llm.jaccard import similar_documents

    return similar_documents(table(spark, folder, "documents"))


# Every 50-byte string in hexadecimal, its smallest document, and the bytes it covers elsewhere.
_OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM d WHERE length(x) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, p, p + 50 AS q FROM s JOIN f USING (g) WHERE doc_id > first),
o AS (SELECT doc_id, p, q, max(q) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT doc_id, p, q, sum(CASE WHEN before IS NULL OR before < p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
m AS (SELECT doc_id, run, min(p) AS a, max(q) AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM m),
t AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept, max(b) AS tail
  FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""


@query("op7_suffixes", _OP7)
def _(spark, folder):
    from tallywatch.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, folder, "documents")).selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256"
    )


@query("op6_neighbours")
def _(spark, folder):
    from tallywatch.llm.neighbours import nearest

    return nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


@query("op8_lines")
def _(spark, folder):
    from tallywatch.llm.lines import repeated_lines

    return repeated_lines(table(spark, folder, "documents")).selectExpr("doc_id", "CAST(line AS BIGINT) AS line")


# All anchors against all rows; the rules of the contract as they stand.
_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""


@query("op11_negatives", _OP11)
def _(spark, folder):
    from tallywatch.llm.negatives import hard_negatives

    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    return hard_negatives(table(spark, folder, "embeddings").selectExpr("vec_id", label, "embedding"), "vec_id % 100 = 0")


@query("op12_simhash")
def _(spark, folder):
    from tallywatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).selectExpr(
        "doc_id", "lower(lpad(hex(print), 16, '0')) AS fingerprint", "component_id", "n_shingles"
    )


# Every term of every item against every document that holds it.
_OP13 = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN i USING (term) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, documents),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * documents) // total))))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10"""


@query("op13_search", _OP13)
def _(spark, folder):
    from tallywatch.llm.lexical import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
