"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are read once into a forward index that holds, per document, its
length and the counts of the query terms. Frequencies over all documents give
each term its weight. Then every task ranks its own documents: it inverts a
chunk of them into posting lists and, per item, takes the terms rarest first. A
posting opens an accumulator for its document only while the best that the terms
left can still add reaches the k-th best partial score; from then on the lists
only update documents that have one, exactly. The k-th score of earlier chunks
counts from the start of the next. The first k of each task, merged by rank,
hold the first k of all documents.

Items are taken in groups of about ``GROUP_TERMS`` terms, so that what is
broadcast is bounded; each group reads the documents once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage, word_pieces

GROUP_TERMS = 1 << 20
POSTINGS = 1 << 21  # inverted at a time
# Bytes of terms stand for themselves, A-Z for a-z, all others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, about a megabyte at a time."""
    return word_pieces((text or b"").translate(_BYTES))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            for words in terms_of(text):
                terms = sorted(set(words))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array([i] * len(terms), pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "term"])


def _forward_rows(numbers):
    """doc_id, number of terms, numbers and counts of the query terms, for documents that have terms."""

    def row_batch(ids, rows, lengths, found):
        size = max(rows, default=0) + 1
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        offsets = pa.array(np.searchsorted(keys >> 32, np.append(rows, size)), pa.int32())
        terms = pa.ListArray.from_arrays(offsets, pa.array((keys & 0xFFFFFFFF).astype(np.int32)))
        times = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), terms, times], names=["doc_id", "n", "terms", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, lengths, found, held = [], [], [], 0
            for i in range(batch.num_rows):
                n = 0
                for words in terms_of(texts[i].as_py()):
                    n += len(words)
                    known = np.fromiter(filter(None, map(number, words)), np.int64)
                    found.append(known + (i << 32))
                    held += len(known)
                if n:
                    rows.append(i)
                    lengths.append(n)
                if held > POSTINGS:
                    yield row_batch(ids, rows, lengths, found)
                    rows, lengths, found, held = [], [], [], 0
            yield row_batch(ids, rows, lengths, found)

    return run


def _frequency_rows(size: int):
    """Documents per term, summed up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


class Postings:
    """Inverted lists of a chunk of documents with what each posting adds to a score."""

    def __init__(self, ids, null, n, sizes, terms, times, weights: np.ndarray, documents: int, total: int):
        self.ids, self.null = ids, null
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = 10 + (90 * n * documents) // max(1, total)
        adds = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.adds = doc[order], adds[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        filled = np.flatnonzero(np.diff(self.start))
        self.peak = np.zeros(len(weights), np.int64)
        if len(filled):
            self.peak[filled] = np.maximum.reduceat(self.adds, self.start[filled])
        self.scores = np.zeros(len(ids), np.int64)

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the first k, with exact scores of ``least`` or more. ``terms``: rarest first."""
        terms = terms[self.peak[terms] > 0]
        left = np.cumsum(self.peak[terms][::-1])[::-1]  # what a term and all behind it can add
        scores, open_ = self.scores, np.zeros(0, np.int64)
        for t, bound in zip(terms, left):
            at = slice(self.start[t], self.start[t + 1])
            doc, adds = self.doc[at], self.adds[at]
            if bound >= least:
                new = doc[(scores[doc] == 0) & (adds > 0)]
                scores[doc] += adds
                open_ = np.concatenate([open_, new])
                if len(open_) >= k:
                    least = max(least, int(np.partition(scores[open_], -k)[-k]))
            else:
                if len(open_) < len(doc) // 8:
                    place = np.minimum(np.searchsorted(doc, open_), len(doc) - 1)
                    has = doc[place] == open_
                    scores[open_[has]] += adds[place[has]]
                else:
                    has = scores[doc] > 0
                    scores[doc[has]] += adds[has]
        found = scores[open_]
        scores[open_] = 0
        return open_[found >= least], found[found >= least]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the forward index in runs of about ``POSTINGS`` postings."""
    held, size = [], 0
    for batch in batches:
        ids, sizes = batch.column("doc_id"), batch.column("terms").value_lengths().to_numpy()
        fixed = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), sizes]
        flat = [batch.column(c).flatten().to_numpy() for c in ("terms", "times")]
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            done = ends[row - 1] if row else 0
            to = max(row + 1, int(np.searchsorted(ends, done + POSTINGS - size, side="right")))
            held.append([*(x[row:to] for x in fixed), *(x[done : ends[to - 1]] for x in flat)])
            size += int(ends[to - 1] - done)
            row = to
            if size >= POSTINGS or row < len(sizes):
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _ranked_rows(k: int, items, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, terms, offsets = items.value
        n = len(offsets) - 1
        best = [np.zeros((3, 0), np.int64)] * n  # score, null id, id
        for chunk in _chunks(batches):
            lists = Postings(*chunk, weights, documents, total)
            for i in range(n):
                held = best[i]
                least = int(held[0, -1]) if held.shape[1] == k else 1
                doc, score = lists.best(terms[offsets[i] : offsets[i + 1]], k, least)
                if len(doc):
                    x = np.concatenate([held, np.stack([score, lists.null[doc], lists.ids[doc]])], axis=1)
                    best[i] = x[:, np.lexsort((x[2], x[1], -x[0]))[:k]]
        for i in range(0, n, 4096):
            part = best[i : i + 4096]
            item = np.repeat(np.arange(i, i + len(part)), [x.shape[1] for x in part])
            score, null, ids = np.concatenate(part, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"]
            )

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's first ``k`` documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z in lower case. Scores are as in the contract: term weights from
    document frequencies, saturated counts, long documents marked down. Equal
    scores go by doc_id, null ids last.

    Items that share an item_id are one item with all their terms; a null
    item_id is an id like any other. Null and empty texts have no terms; such
    items have no rows and such documents do not count. Repeated rows of
    ``docs`` are documents of their own. Empty tables give no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = items.schema["item_id"].dataType.simpleString()
    docs = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS binary) AS text")
    asked = stage(
        items.selectExpr("item_id", "CAST(text AS binary) AS text").mapInArrow(_item_rows, f"item_id {kind}, term binary").distinct(), "item_terms"
    )
    groups = -(-asked.count() // GROUP_TERMS)
    result = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    found = []
    for g in range(groups):
        # the terms of one group: about GROUP_TERMS
        own = asked.where(f"pmod(xxhash64(item_id), {groups}) = {g}").groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
        if not own.num_rows:
            continue
        lists = own.column("terms").to_pylist()
        vocabulary = sorted({t for x in lists for t in x})
        number = {t: i for i, t in enumerate(vocabulary, 1)}
        forward = stage(
            docs.mapInArrow(_forward_rows(sc.broadcast(number)), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), "forward_index"
        )
        documents, total = forward.selectExpr("count(*)", "COALESCE(sum(n), 0)").first()
        counted = forward.select("terms").mapInArrow(_frequency_rows(len(number) + 1), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(number) + 1, np.int64)
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.array([weight(documents, int(x)) for x in df])
        numbered = [np.array([number[t] for t in x]) for x in lists]
        ordered = np.concatenate([x[np.argsort(df[x], kind="stable")] for x in numbered])
        offsets = np.cumsum([0, *map(len, lists)])
        ranked = forward.mapInArrow(
            _ranked_rows(k, sc.broadcast((weights, ordered, offsets)), documents, total), "item int, doc_id bigint, score bigint"
        ).selectExpr("*", "row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank").where(f"rank <= {k}")
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(own.num_rows), pa.int32()), "item_id": own.column("item_id")}), f"item int, item_id {kind}"
        )
        # the right side is bounded by the items of one group
        full = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found.append(stage(full, "ranked") if groups > 1 else full)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], result)
