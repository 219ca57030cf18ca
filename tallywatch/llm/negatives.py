"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Vectors become whole numbers, and scores are their inner products. Anchors are
the stated query rows; they are taken in groups of at most ``GROUP_BYTES``,
each group is broadcast and all rows are read past it in tiles:

* a first pass multiplies anchor tiles by candidate tiles that share a label and
  keeps the best rows per anchor, its positives;
* a second pass multiplies the tiles that hold different labels and keeps, per
  anchor and positive, the best rows inside the window that the positive's score
  opens.

Tiles are ordered by label, so the two passes together multiply nearly every
tile pair once. A product is Strassen's recursion on int64 with zero rows and
columns added where a side is odd. int64 sums wrap around, so whatever
intermediate sums do, a product that fits 63 bits comes out exactly.

A task keeps one bounded heap per anchor (or anchor and positive). Heaps of
tasks merge by rank, so a lost task costs its own tiles only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage

GROUP_BYTES = 1 << 24  # integers of the anchors that are broadcast together
ANCHOR_TILE = 256
CANDIDATE_TILE = 1024
SMALL_TILE = 32  # a tile with fewer rows goes on beyond the end of its label
LEAF = 12  # sides up to this length are multiplied directly
HELD = 1 << 18  # entries that wait for the next merge of the heaps

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices by seven products of their quarters, again and again."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    h, c, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :c], a[:h, c:], a[h:, :c], a[h:, c:]
    b11, b12, b21, b22 = b[:c, :w], b[:c, w:], b[c:, :w], b[c:, w:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The first ``k`` entries per slot, by score downwards and then by id."""

    def __init__(self, slots: int, k: int):
        self.k, self.waiting = k, 0
        self.held = [np.zeros((3, 0), np.int64)]
        self.least = np.full(slots, np.iinfo(np.int64).min)  # a lower score cannot enter

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if len(slot):
            self.held.append(np.stack([slot, score, id_]))
            self.waiting += len(slot)
            if self.waiting > HELD:
                self.merge()

    def merge(self) -> np.ndarray:
        x = np.concatenate(self.held, axis=1)
        x = x[:, np.lexsort((x[2], ~x[1], x[0]))]  # ~ reverses the order of int64 without overflow
        first = np.searchsorted(x[0], x[0])
        place = np.arange(x.shape[1]) - first
        x = x[:, place < self.k]
        full = place[place < self.k] == self.k - 1
        self.least[x[0, full]] = x[1, full]
        self.held, self.waiting = [x], 0
        return x


def integer_rows(batch: pa.RecordBatch, scale: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole-number vectors of the rows that take part, ordered by label."""
    vectors = batch.column("embedding")
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0
        good &= np.bincount(row, flat * flat, len(sizes)) < 2.0**63
    good &= vectors.is_valid().to_numpy(zero_copy_only=False)
    for name in ("vec_id", "label"):
        good &= batch.column(name).is_valid().to_numpy(zero_copy_only=False)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width), np.int64)
    used = good[row]
    out[row[used], place[used]] = flat[used].astype(np.int64)
    ids, labels = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("vec_id", "label"))
    at = np.flatnonzero(good)
    at = at[np.argsort(labels[at], kind="stable")]
    return ids[at], labels[at], out[at]


def tiles(labels: np.ndarray, most: int) -> Iterator[slice]:
    """Cut rows that are in order of label: at ``most`` rows, and where a label ends if the tile is not small."""
    ends = np.append(np.flatnonzero(np.diff(labels)) + 1, len(labels)) if len(labels) else []
    start = 0
    for end in ends:
        while end - start >= most:
            yield slice(start, start + most)
            start += most
        if end - start >= SMALL_TILE:
            yield slice(start, end)
            start = end
    if start < len(labels):
        yield slice(start, len(labels))


def _pairs(batches, scale: int, width: int, anchors, same: bool):
    """Tile pairs with their scores, and where the labels are equal (or differ) and the ids differ."""
    ids, labels, matrix = anchors
    own_tiles = list(tiles(labels, ANCHOR_TILE))
    for batch in batches:
        row_ids, row_labels, rows = integer_rows(batch, scale, width)
        for c in tiles(row_labels, CANDIDATE_TILE):
            turned = np.ascontiguousarray(rows[c].T)
            low, high = row_labels[c.start], row_labels[c.stop - 1]
            for a in own_tiles:
                first, last = labels[a.start], labels[a.stop - 1]
                if (last < low or high < first) if same else first == last == low == high:
                    continue
                fits = (labels[a, None] == row_labels[None, c]) == same
                fits &= ids[a, None] != row_ids[None, c]
                yield a, row_ids[c], strassen(matrix[a], turned), fits


def _emitted(heaps: Heaps) -> Iterator[pa.RecordBatch]:
    slot, score, id_ = heaps.merge()
    for i in range(0, len(slot), HELD):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + HELD]) for x in (slot, score, id_)], names=["slot", "score", "id"])


def _positive_rows(scale: int, width: int, k: int, anchors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(anchors.value[0]), k)
        for a, ids, scores, fits in _pairs(batches, scale, width, anchors.value, True):
            if not fits.any():
                continue
            scores[~fits] = np.iinfo(np.int64).min
            least = heaps.least[a]
            if scores.shape[1] > k:  # nothing below the k-th score of this tile can be among the first k
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero((scores >= least[:, None]) & fits)
            heaps.add(i + a.start, scores[i, j], ids[j])
        yield from _emitted(heaps)

    return run


def _negative_rows(scale: int, width: int, k: int, anchors, windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, low, high = windows.value  # per anchor and positive; slot -1 where there is no positive
        heaps = Heaps(int(slots.max(initial=-1)) + 1, k)
        for a, ids, scores, fits in _pairs(batches, scale, width, anchors.value, False):
            for p in range(slots.shape[1]):
                own = slots[a, p]
                least = np.where(own >= 0, np.maximum(low[a, p], heaps.least[own]), np.iinfo(np.int64).max)
                i, j = np.nonzero((scores >= least[:, None]) & (scores <= high[a, p, None]) & (own >= 0)[:, None] & fits)
                heaps.add(own[i], scores[i, j], ids[j])
        yield from _emitted(heaps)

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    return rows.selectExpr("*", "row_number() OVER (PARTITION BY slot ORDER BY score DESC, id) AS rank").where(f"rank <= {k}")


def _bound(share: int, score: int, up: bool) -> int:
    """share * score / 100, rounded, in whole numbers of any size and then within 64 bits."""
    x = -((-share * score) // 100) if up else (share * score) // 100
    return max(-(1 << 63), min((1 << 63) - 1, x))


def hard_negatives(
    rows: DataFrame, anchors: str, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """Hard negatives per anchor and positive: ``RESULT``.

    ``rows`` has vec_id, label and embedding; ``anchors`` is a condition on them.
    A component x becomes floor(scale * x). An anchor's positives are the first
    ``positives`` other rows with its label, by score downwards, then by vec_id;
    per positive the first ``negatives`` rows of other labels are returned whose
    score is between ``low`` and ``high`` percent of the positive's.

    Rows with a null vec_id, label, vector or component, or a component that is
    not finite, take no part, nor do rows whose vector's squared length is 2**63
    or more, as scores would not be 64-bit numbers. Vectors of different lengths
    are filled up with zeros. Rows that share a vec_id are rows of their own, but
    never each other's positive or negative; a repeated anchor gives its rows as
    often as it stands there. Without anchors, positives or negatives there are
    no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    rows = rows.selectExpr("CAST(vec_id AS bigint) AS vec_id", "CAST(label AS bigint) AS label", "CAST(embedding AS array<double>) AS embedding")
    n, width = rows.selectExpr(f"count_if({anchors})", "COALESCE(max(size(embedding)), 0)").first()
    width = max(1, width)
    groups = -(-n * width * 8 // GROUP_BYTES)
    entry = "slot bigint, score bigint, id bigint"
    found = []
    for g in range(groups):
        part = rows.where(F.expr(anchors)).where(f"pmod(xxhash64(vec_id, embedding), {groups}) = {g}").toArrow().combine_chunks()
        if not len(part):
            continue
        own = integer_rows(part.to_batches()[0], scale, width)
        held = sc.broadcast(own)
        best = _first(rows.mapInArrow(_positive_rows(scale, width, positives, held), entry), positives).toArrow()
        slot, rank, score = (best.column(c).to_numpy() for c in ("slot", "rank", "score"))
        slots = np.full((len(own[0]), positives), -1)
        bounds = np.zeros((2, *slots.shape), np.int64)
        slots[slot, rank - 1] = np.arange(len(slot))
        for k, (share, up) in enumerate(((low, True), (high, False))):
            bounds[k, slot, rank - 1] = [_bound(share, s, up) for s in score.tolist()]
        chosen = spark.createDataFrame(
            pa.table({"slot": np.arange(len(slot)), "anchor_id": own[0][slot], "positive_id": best.column("id"), "positive_score": score}),
            "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        worst = _first(rows.mapInArrow(_negative_rows(scale, width, negatives, held, sc.broadcast((slots, *bounds))), entry), negatives)
        # the right side is bounded by the anchors of one group
        full = worst.join(F.broadcast(chosen), "slot").selectExpr(
            "anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score"
        )
        found.append(stage(full, "negatives") if groups > 1 else full)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)
