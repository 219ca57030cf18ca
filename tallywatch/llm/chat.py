"""Chat formatting: collapse cumulative snapshots, then render.

A logged conversation whose turns begin a longer one is a snapshot of it. Each
turn gets a rolling hash of everything up to it: the sum of a hash of (place,
turn) over the turns so far, kept as two exact decimal sums of 64-bit hashes. A
conversation is dropped by an anti-join if its last hash is the hash of a
proper prefix; of equal conversations the smallest id stays.

Turns are handled in runs of 4,096 numbers, with sums carried between the runs,
so no task gathers a conversation of unbounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage

RUN = 4096
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _carried(turns: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums per conversation by turn number: inside runs, plus the runs before."""
    inner = turns.selectExpr(
        "*", *[f"SUM({v}) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS UNBOUNDED PRECEDING) AS {k}_in" for k, v in sums.items()]
    )
    runs = turns.groupBy("conv_id", "run").agg(*[F.expr(f"SUM({v}) AS {k}_all") for k, v in sums.items()]).selectExpr(
        "conv_id", "run", *[f"COALESCE(SUM({k}_all) OVER (PARTITION BY conv_id ORDER BY run {_BEFORE}), 0) AS {k}_before" for k in sums]
    )
    kept = turns.columns
    return inner.join(runs, ["conv_id", "run"]).selectExpr(*kept, *[f"{k}_in + {k}_before AS {k}" for k in sums])


def prefix_hashes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, run, place (1 for the first turn), n_messages, and the rolling hash (p1, p2)."""
    hashed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").selectExpr(
        "conv_id", "turn", "xxhash64(role, text, 1) AS a", "xxhash64(text, 2, role) AS b"
    ).distinct()
    turns = hashed.groupBy("conv_id", "turn").agg(
        F.expr("SUM(CAST(a AS DECIMAL(28, 0))) AS a"), F.expr("SUM(CAST(b AS DECIMAL(28, 0))) AS b"), F.expr("COUNT(*) AS n_messages")
    ).selectExpr("*", f"CAST(floor(turn / {RUN}) AS BIGINT) AS run")
    placed = _carried(turns, {"place": "1L"})
    terms = placed.selectExpr(
        "conv_id", "turn", "run", "place", "n_messages",
        "CAST(xxhash64(place, a, b) AS DECIMAL(28, 0)) AS u", "CAST(xxhash64(b, place, a) AS DECIMAL(28, 0)) AS v",
    )
    return _carried(terms, {"p1": "u", "p2": "v"}).drop("u", "v")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no longer one begins with."""
    last = turns.groupBy("conv_id").agg(F.expr("max_by(struct(place, p1, p2), place) AS e"))
    whole = last.groupBy("e.place", "e.p1", "e.p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = (
        turns.alias("t").join(last.alias("l"), "conv_id").where("t.place < l.e.place")
        .select("place", "p1", "p2").distinct()
    )
    return whole.join(proper, ["place", "p1", "p2"], "left_anti").selectExpr("conv_id", "place AS n_turns", "n_copies")


def render(messages: DataFrame) -> DataFrame:
    """Rendered text of the maximal conversations: conv_id, n_turns, n_copies, part, text.

    A message becomes ``<|role|>``, a line break, its text and a line break.
    Parts are runs of 4,096 turn numbers (ordinary conversations are part 0
    alone); their texts in order of part are the conversation.

    Messages without conv_id or turn are left out. Repeated messages count once;
    several different messages with one turn number follow each other by role
    and text, and a turn of more than 4,096 of them is spread over parts of its
    own. Null roles and texts render as empty. An empty table gives no rows.
    Other columns are ignored.
    """
    turns = stage(prefix_hashes(messages), "prefix_hashes")
    kept = maximal(turns)
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    first = turns.join(kept, "conv_id").selectExpr(
        "conv_id", "turn", "n_turns", "n_copies", "run",
        f"IF(n_messages > {RUN}, turn, NULL) AS crowded", f"1 + n_messages DIV {RUN} AS spread",
    )
    parts = (
        rows.join(first, ["conv_id", "turn"])
        .selectExpr("*", "IF(crowded IS NULL, 0, pmod(xxhash64(role, text), spread)) AS share")
        .groupBy("conv_id", "n_turns", "n_copies", "run", "crowded", "share")
        .agg(F.expr("array_sort(collect_list(struct(turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text))) AS said"))
    )
    order = "ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY said[0].turn, share) - 1"
    texts = parts.selectExpr(
        "conv_id", "n_turns", "n_copies", f"{order} AS part",
        "array_join(transform(said, m -> concat('<|', m.role, '|>\\n', m.text, '\\n')), '') AS text",
    )
    return texts.selectExpr("conv_id", "n_turns", "n_copies", "CAST(part AS BIGINT) AS part", "text")
