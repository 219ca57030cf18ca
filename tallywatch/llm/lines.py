"""Near-duplicate lines by an exact set-similarity join, in built-in functions only.

A line is the set of its words. Two lines match at a Jaccard similarity of
``percent`` or more. Words carry a code that sorts rare words first (frequency
class of one of 2**20 buckets counted over all texts, then hash), so the first
``n - ceil(t n) + 1`` codes of a line, its prefix, are its rarest words, and
matching lines share one of them. Of what shares a prefix word, the length filter,
the positional filter and a parity filter (128 bits per line, of which each word
turns one over; so no more bits differ than words) leave candidates, and only these lines are read
again and verified word by word.

A line is removed if an earlier one matches it, so it need not meet all of them.
Large groups of near copies are settled first: by two words of its prefix a line
meets the first few lines that have them there too. In lists that then hold many
settled lines the open ones meet ever more of the first lines, by all their prefix
words, as long as that settles any. Pairs of two lines that were settled so are not
looked at again; all others meet in the lists of prefix words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.llm.common import Stages, stage

BUCKETS = 1 << 20  # eight to a long
MAP_BITS = 16  # the bitmap of wanted lines: 2**16 longs
KEYS = 2  # prefix words by which a line meets
PIVOTS = 4  # first lines that have them
CROWD_PIVOTS = 16  # first lines met in a crowded list; sixteen times as many in each further round
# [\s\p{Punct}] with each character by itself, which java.util.regex looks up in a table
_PARTS = "'[" + "".join(f"\\\\u{ord(c):04x}" for c in " \t\n\v\f\r" + string.punctuation) + "]+'"
_WORDS = f"array_remove(split(lower({{0}}), {_PARTS}), '')"
_HASHES = f"array_distinct(transform({_WORDS}, w -> xxhash64(w)))"
_ALONE = 1 << 57  # codes below are words that occur once in all texts

# what orders lines: a row of three numbers
_PLACE = "struct(COALESCE(CAST(doc_id AS BIGINT), 9223372036854775807) AS d, text_hash AS t, line AS l)"


def _word_classes(docs: DataFrame) -> DataFrame:
    """One row: the frequency class of each bucket of words, counted over whole texts, as an array of 2**20 bytes."""
    words = docs.selectExpr(f"explode_outer(split(lower(text), {_PARTS})) AS w").where("w != ''")
    counts = words.groupBy(F.expr(f"xxhash64(w) & {BUCKETS - 1}L AS bucket")).count()
    packed = counts.selectExpr(
        "shiftright(bucket, 3) AS slot", "shiftleft(CAST(least(62, floor(2 * log2(count))) AS LONG), CAST(8 * (bucket & 7) AS INT)) AS value"
    ).groupBy("slot").agg(F.expr("bit_or(value) AS value"))
    each = "transform(array(0, 8, 16, 24, 32, 40, 48, 56), k -> CAST(shiftrightunsigned(x, k) & 63L AS TINYINT))"
    return _dense(packed, BUCKETS // 8).selectExpr(f"flatten(transform(slots, x -> {each})) AS classes")


def _dense(values: DataFrame, slots: int) -> DataFrame:
    """One row with an array of ``slots`` longs (a fixed number): ``value`` at each ``slot``, 0 elsewhere."""
    every = values.sparkSession.range(slots).withColumnRenamed("id", "slot").join(values, "slot", "left")
    return every.agg(F.expr("transform(sort_array(collect_list(struct(slot, COALESCE(value, 0L) AS value))), x -> x.value) AS slots"))


def _lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """A row per line: doc_id, text_hash, line (from 0), codes.

    The classes (a megabyte, of fixed size) are a scalar subquery, as a joined column
    would be copied with every row. Lines without words are still there: a filter
    on the codes here would make them a second time.
    """
    code = f"COALESCE(shiftleft(CAST(classes[CAST(h & {BUCKETS - 1}L AS INT)] AS BIGINT), 57), 0L) | (h & {_ALONE - 1}L)"
    return (
        docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "split(text, '\\n', -1) AS xs")
        .selectExpr("doc_id", "text_hash", "posexplode_outer(xs) AS (line, x)")
        .withColumn("classes", classes.scalar())
        .selectExpr("doc_id", "text_hash", "line", f"sort_array(transform({_HASHES.format('x')}, h -> {code})) AS codes")
    )


def _slot(value: str) -> tuple[str, str]:
    return f"CAST(shiftrightunsigned({value}, 6) & {(1 << MAP_BITS) - 1}L AS INT)", f"CAST({value} & 63 AS INT)"


def _bitmap(df: DataFrame, value: str) -> DataFrame:
    """One row: a bitmap of 2**22 bits of the column's values."""
    word, bit = _slot(value)
    bits = df.selectExpr(f"CAST({word} AS LONG) AS slot", f"shiftleft(1L, {bit}) AS bit").groupBy("slot").agg(F.expr("bit_or(bit) AS value"))
    return _dense(bits, 1 << MAP_BITS)


def _has(bits: DataFrame, value: str) -> Column:
    """Whether the value's bit is set; other values may share it."""
    word, bit = _slot(value)
    return F.call_function("getbit", F.get(bits.scalar(), F.expr(word)), F.expr(bit)) == 1


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, line of every line that an earlier one matches.

    Lines are ordered by doc_id (null last), text_hash and place. Lines without
    words, and null or empty texts, match nothing. Repeated rows of one document
    have the same lines, so within them only the lines of the first count as
    earlier. Texts and lines of any length are whole; empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    # the least number of shared words is ceil(percent * n / 100)
    spare = f"size(codes) - CAST(ceil({percent} * size(codes) / 100D) AS INT)"
    # lists are keyed by 31 bits of a word's hash: words that share them only add candidates
    prefix = f"transform(slice(codes, 1, {spare} + 1), c -> IF(c < {_ALONE}L, NULL, CAST(c & 2147483647L AS INT)))"
    early = Stages(docs.sparkSession)
    lines = early.stage(
        _lines(docs, early.stage(_word_classes(docs), "word_classes")).selectExpr(
            "doc_id", "text_hash", "line", "xxhash64(codes) AS node", "CAST(size(codes) AS BIGINT) AS n", f"{prefix} AS prefix",
            *[f"aggregate(codes, 0L, (s, c) -> IF((c & 64) = {64 * k}, s ^ shiftleft(1L, CAST(c & 63 AS INT)), s)) AS bits{k}" for k in (0, 1)],
        ),
        "lines",
    ).where("n > 0")
    # equal lines are one node, placed where the first of them stands
    firsts = stage(
        lines.selectExpr("node", "n", "prefix", "bits0", "bits1", f"{_PLACE} AS place").groupBy("node")
        .agg(F.min("place").alias("place"), *[F.min(c).alias(c) for c in ("n", "prefix", "bits0", "bits1")]),
        "first_lines",
    )
    places = stage(lines.select("doc_id", "text_hash", "line", "node"), "places")
    early.release()
    # lines match if (100 + percent) * shared words >= percent * (x.n + y.n); n + n - shared - shared words differ
    alike = f"""100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND {100 + percent} * (bit_count(x.bits0 ^ y.bits0) + bit_count(x.bits1 ^ y.bits1)) <= {100 - percent} * (x.n + y.n)"""
    pair = ["x.node AS node", "y.node AS other"]

    met = firsts.selectExpr("node", "n", "place", "bits0", "bits1", f"explode(slice(sort_array(array_compact(prefix)), 1, {KEYS})) AS code")
    pivots = met.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY code ORDER BY place) AS k").where(f"k <= {PIVOTS}").drop("k")
    near = met.alias("x").join(pivots.alias("y"), F.expr(f"x.code = y.code AND y.place < x.place AND {alike}"))
    settled = _verified(docs, firsts, near.selectExpr(*pair).distinct(), percent)

    size, rounds, crowd = CROWD_PIVOTS, Stages(docs.sparkSession), None
    known = rounds.stage(_bitmap(settled, "node"), "known")
    while True:
        # the first round looks through all lines, the others through those in lists that were crowded then
        if crowd is None:
            members = firsts.where(_has(known, "node")).selectExpr("node", "explode(array_compact(prefix)) AS code")
        else:
            members = crowd.select("node", "code")
        members = members.join(settled, "node", "left_semi")
        crowded = rounds.stage(members.groupBy("code").count().where(f"count >= {2 * size}").select("code"), "crowded")
        if crowded.isEmpty():
            break
        if crowd is None:
            bits = rounds.stage(_bitmap(crowded, "xxhash64(code)"), "bits")
            crowd = firsts.selectExpr("node", "n", "place", "bits0", "bits1", "explode(array_compact(prefix)) AS code").where(_has(bits, "xxhash64(code)"))
        crowd = rounds.stage(crowd.join(crowded, "code", "left_semi"), "crowd")
        pivots = crowd.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY code ORDER BY place) AS k").where(f"k <= {size}").drop("k")
        near = crowd.join(settled, "node", "left_anti").alias("x").join(pivots.alias("y"), F.expr(f"x.code = y.code AND y.place < x.place AND {alike}"))
        more = _verified(docs, firsts, near.selectExpr(*pair).distinct(), percent)
        if more.isEmpty():
            break
        settled, size = settled.unionByName(more), 16 * size

    # one shuffle serves both sides; a pair counts if its later line is open. Of lines that the bitmap does not let through none is settled
    known = rounds.stage(_bitmap(settled, "node"), "known")
    held = firsts.where(_has(known, "node")).join(settled.withColumn("settled", F.lit(True)), "node", "left")
    free = firsts.where(~_has(known, "node")).withColumn("settled", F.lit(None).cast("boolean"))
    lists = (
        held.unionByName(free)
        .selectExpr("node", "n", "place.d AS d", "bits0", "bits1", "settled IS NULL AS open", "posexplode(prefix) AS (at, code)")
        .where("code IS NOT NULL")
    )
    match = f"""x.code = y.code AND x.node < y.node AND {alike}
        AND {100 + percent} * (least(x.n - x.at, y.n - y.at) + least(x.at, y.at)) >= {percent} * (x.n + y.n)
        AND ((x.open AND x.d >= y.d) OR (y.open AND y.d >= x.d))"""
    rest = _verified(docs, firsts, lists.alias("x").join(lists.alias("y"), F.expr(match)).selectExpr(*pair).distinct(), percent)
    rounds.release()
    matched = stage(settled.unionByName(rest).distinct(), "matched").withColumn("near", F.lit(True))
    return (
        places.selectExpr("doc_id", "text_hash", "line", "node", f"{_PLACE} AS place")
        .join(firsts.selectExpr("node", "place AS first"), "node")
        .join(matched, "node", "left")
        .where("near OR place > first")
        .select("doc_id", "text_hash", "line")
    )


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later node of each of the ``pairs`` whose Jaccard similarity suffices, staged."""
    held = Stages(docs.sparkSession)
    pairs = held.stage(pairs, "pairs")
    nodes = held.stage(pairs.select("node").unionByName(pairs.selectExpr("other AS node")).distinct(), "nodes")
    # bitmaps let few other rows through to the joins, which decide
    known = held.stage(_bitmap(nodes, "node"), "known")
    homes = held.stage(nodes.join(firsts.where(_has(known, "node")), "node").selectExpr("node", "place.d AS d", "place.t AS t", "place.l AS l"), "homes")
    # texts without a wanted line are not split, and only wanted lines are hashed
    places = homes.selectExpr("explode(array(xxhash64(d, t), xxhash64(d, t, l))) AS place")
    bits = held.stage(_bitmap(places, "place"), "bits")
    wanted = (
        docs.selectExpr("COALESCE(CAST(doc_id AS BIGINT), 9223372036854775807) AS d", "xxhash64(text) AS t", "text")
        .where(_has(bits, "xxhash64(d, t)"))
        .selectExpr("d", "t", "posexplode_outer(split(text, '\\n', -1)) AS (l, x)")
        .where(_has(bits, "xxhash64(d, t, l)"))
        .selectExpr("d", "t", "l", f"{_HASHES.format('x')} AS words")
    )
    sets = wanted.join(homes, ["d", "t", "l"]).selectExpr("node", "struct(d, t, l) AS place", "words").groupBy("node").agg(
        F.min("place").alias("place"), F.first("words").alias("words")
    )
    shared = "size(array_intersect(x.words, y.words))"
    later = stage(
        pairs.join(sets.alias("x"), "node")
        .join(sets.withColumnRenamed("node", "other").alias("y"), "other")
        .where(f"100 * {shared} >= {percent} * (size(x.words) + size(y.words) - {shared})")
        .selectExpr("IF(x.place > y.place, node, other) AS node")
        .distinct(),
        "settled",
    )
    held.release()
    return later


def remove_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without their repeated lines, with all their columns; ``n_chars``, if there, is counted again.

    A document all of whose lines with words are repeated has nothing of its own
    left and is left out; a document that had no words stays as it is.
    """
    gone = repeated_lines(docs, percent).groupBy("doc_id", "text_hash").agg(F.expr("collect_set(line) AS gone"))
    joined = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND xxhash64(d.text) = g.text_hash"), "left")
    rest = "array_join(filter(split(d.text, '\\n', -1), (x, i) -> NOT array_contains(g.gone, i)), '\\n')"
    kept = joined.where(f"g.gone IS NULL OR trim({rest}) RLIKE '[^\\\\s\\\\p{{Punct}}]'")
    out = kept.selectExpr(*[f"IF(g.gone IS NULL, d.text, {rest}) AS text" if c == "text" else f"d.`{c}`" for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
