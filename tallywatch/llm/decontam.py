"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``window`` consecutive words, or the whole item if shorter)
must be contained in a document entirely, so every shingle of a window is
necessary and the necessary prefix is one shingle: the rarest. Shingles of the
items are counted over all documents; each window is then joined on its rarest
shingle only, the shingle's place in the window fixes where the window would
start (positional bound; it must fit into the document, the length bound), and
the window there is verified word for word by its hash.

Documents are never shuffled: tasks pass on only positions whose shingle is in
a bitmap of fixed size, and the join on the shingle decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import ALPHANUMERIC, bitmap, hash_words, in_bitmap, lowered, shingles, signed, stage

BITMAP_BITS = 25
KEY = ["doc_id", "text_hash"]


def _item_rows(window: int, shingle: int):
    """Windows of the items: one row per window and shingle inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = lowered(batch.column("text")), batch.column("item_id").to_pylist()
            for first, last, hashes, offsets in hash_words(texts, ALPHANUMERIC):
                for i in range(last - first):
                    words = hashes[offsets[i] : offsets[i + 1]]
                    n = min(window, len(words))
                    if not n:
                        continue
                    size = min(shingle, n)
                    whole, parts = shingles(words, n), shingles(words, size)
                    inside = n - size + 1
                    place = np.tile(np.arange(inside, dtype=np.int32), len(whole))
                    row = np.repeat(np.arange(len(whole)), inside)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([items[first + i]] * len(row), pa.string()),
                            pa.array(np.full(len(row), n, np.int32)),
                            pa.array(signed(whole[row])),
                            pa.array(place),
                            pa.array(signed(parts[row + place])),
                        ],
                        names=["item_id", "size", "window_hash", "place", "token"],
                    )

    return run


def _count_rows(sizes: list[int], table):
    """How often the items' shingles stand in documents, summed up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, offsets in hash_words(lowered(batch.column("text")), ALPHANUMERIC):
                for size in sizes:
                    found = _inside(hashes, offsets, size, size)
                    found = found[1][in_bitmap(found[1], table.value)]
                    if len(found):
                        token, n = np.unique(found, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(n)], names=["token", "n"])

    return run


def _inside(hashes: np.ndarray, offsets: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of ``size`` words with ``reach`` words before their text's end."""
    runs = shingles(hashes, size)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(runs)]
    at = np.flatnonzero(np.arange(len(runs)) + reach <= end)
    return at, runs[at]


def _document_rows(pairs: list[tuple[int, int]], table):
    """A row with the word count per document, and one per position where an item's shingle may stand.

    ``near`` holds, per place the shingle can have in a window, the hash of the
    window that would then surround it; 0 where it would leave the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids, rows, keys, words, at, size, token, near):
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    pa.array(keys[rows]),
                    pa.array(words, pa.int64()) if words is not None else pa.nulls(n, pa.int64()),
                    pa.array(at, pa.int64()) if at is not None else pa.nulls(n, pa.int64()),
                    pa.array(np.full(n, size, np.int32)),
                    pa.array(signed(token)) if token is not None else pa.nulls(n, pa.int64()),
                    pa.array([x for x in signed(near)], pa.list_(pa.int64())) if near is not None else pa.nulls(n, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_words", "position", "size", "token", "near"],
            )

        for batch in batches:
            raw = batch.column("text").to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest("" if t is None else t) for t in raw], np.uint64).view(np.int64)
            texts, ids = ["" if t is None else t for t in raw], batch.column("doc_id")
            texts = [t.encode().lower() for t in texts]
            for first, last, hashes, offsets in hash_words(texts, ALPHANUMERIC):
                yield batch_of(ids, np.arange(first, last), keys, np.diff(offsets), None, 0, None, None)
                for n, size in pairs:
                    at, token = _inside(hashes, offsets, size, size)
                    hit = in_bitmap(token, table.value)
                    at, token = at[hit], token[hit]
                    if not len(at):
                        continue
                    doc = np.searchsorted(offsets, at, side="right") - 1
                    whole = shingles(hashes, n)
                    starts = at[:, None] - np.arange(n - size + 1)[None, :]
                    fits = (starts >= offsets[doc][:, None]) & (starts + n <= offsets[doc + 1][:, None])
                    near = np.where(fits, whole[np.clip(starts, 0, max(0, len(whole) - 1))] if len(whole) else 0, 0)
                    yield batch_of(ids, first + doc, keys, None, at - offsets[doc], n, token, near.astype(np.uint64))

    return run


def windows_in_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Word counts of the documents, and the occurrences of the benchmark's windows in them.

    Words are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z in lower case. Returns ``(counts, hits)``: counts has
    doc_id, text_hash and n_words for each row of ``docs``; hits has doc_id,
    text_hash, start, size and item_id, without repeats.

    Null texts and items have no words. Repeated rows repeat in ``counts`` and
    share their hits. A null item_id counts as the item ''. Empty tables give no
    hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    parts = stage(
        items.mapInArrow(_item_rows(window, shingle), "item_id string, size int, window_hash bigint, place int, token bigint"),
        "item_windows",
    )
    # at most ``window`` different sizes
    pairs = sorted((r["size"], min(shingle, r["size"])) for r in parts.select("size").distinct().collect())
    tokens = parts.select("token").distinct()
    counted = (
        docs.select("text")
        .mapInArrow(_count_rows(sorted({s for _, s in pairs}), sc.broadcast(bitmap(tokens, "token", BITMAP_BITS))), "token bigint, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
    )
    # a window whose rarest shingle never occurs cannot occur either
    rarest = stage(
        parts.select("size", "window_hash", "place", "token").distinct()
        .join(counted, "token", "left")
        .groupBy("size", "window_hash")
        .agg(F.expr("min(struct(COALESCE(n, 0) AS n, token, place)) AS rarest"))
        .where("rarest.n > 0")
        .selectExpr("size", "window_hash", "rarest.token", "rarest.place"),
        "rarest_shingles",
    )
    rows = stage(
        docs.select("doc_id", "text").mapInArrow(
            _document_rows(pairs, sc.broadcast(bitmap(rarest, "token", BITMAP_BITS))),
            f"doc_id {kind}, text_hash bigint, n_words bigint, position bigint, size int, token bigint, near array<bigint>",
        ),
        "document_positions",
    )
    counts = rows.where("n_words IS NOT NULL").select(*KEY, "n_words")
    hits = (
        rows.where("token IS NOT NULL").drop("n_words")
        .join(rarest, ["size", "token"])
        .where("near[place] = window_hash")
        .selectExpr(*KEY, "position - place AS start", "size", "window_hash")
        .distinct()
        .join(parts.select("size", "window_hash", "item_id").distinct(), ["size", "window_hash"])
        .select(*KEY, "start", "size", "item_id")
    )
    return counts, hits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, items (sorted), by ``windows_in_documents``."""
    counts, hits = windows_in_documents(docs, benchmark, window, shingle)
    hits = stage(hits, "hits")
    by_doc = ", ".join(KEY)
    covered = (
        hits.select(*KEY, "start", "size").distinct()
        .selectExpr(
            *KEY, "start", "start + size AS stop",
            f"max(start + size) OVER (PARTITION BY {by_doc} ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached",
        )
        .groupBy(*KEY)
        .agg(F.expr("SUM(greatest(0, stop - greatest(start, COALESCE(reached, 0)))) AS n_hit"))
    )
    named = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = covered.alias("c").join(named.alias("n"), [F.expr(f"c.{k} <=> n.{k}") for k in KEY]).selectExpr(
        *[f"c.{k}" for k in KEY], "n_hit", "items"
    )
    return counts.alias("a").join(found.alias("b"), [F.expr(f"a.{k} <=> b.{k}") for k in KEY], "left").selectExpr(
        *[f"a.{k}" for k in KEY], "n_words", "COALESCE(n_hit, 0) AS n_hit", "COALESCE(items, CAST(array() AS array<string>)) AS items"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    hit = contamination(docs, benchmark, window, shingle).where("n_hit > 0").select("doc_id").distinct()
    return docs.alias("d").join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id"), "left_anti")
