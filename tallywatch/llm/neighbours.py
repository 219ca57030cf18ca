"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected by Gaussian (2-stable) rows, so a projected squared
distance is the true one times a chi-square variable of ``dims`` degrees. A
kd-tree over a bounded sample of the projected vectors cuts the space into
blocks; every vector is put into its block, and each block has a kd-tree of its
own. A query first searches its home block. After that its k-th best distance d
is known, and only blocks whose boxes pass the test below are searched.

Within a block, leaves are taken in order of projected distance r and all their
vectors verified by their true inner products. The search stops when
``r^2 / d^2`` exceeds the chi-square quantile: a vector still unseen would then
be nearer than d with a chance of ``1 - confidence`` at most.

Largest inner product becomes least distance by one more coordinate that fills
every vector up to the greatest norm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage

DIMS = 16
CONFIDENCE = 0.98
SAMPLE_ROWS = 20_000  # vectors that the cut into blocks is fitted on
BLOCK_ROWS = 8_192  # vectors aimed at per block
LEAF_ROWS = 64
CHUNK_ROWS = 1_024  # queries that visit a block in one task
STEP = 4  # leaves between two tests


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile by bisection on the series of the regularised incomplete gamma function."""

    def cdf(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 10.0 * dims + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def _projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(20250101).standard_normal((width + 1, dims))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def _filled(x: np.ndarray, greatest: float) -> np.ndarray:
    """The coordinate that fills vectors up to the greatest norm."""
    return np.sqrt(np.maximum(greatest * greatest - (x * x).sum(1), 0.0))


# ---- kd-trees --------------------------------------------------------------
def kd_tree(x: np.ndarray, leaves: int) -> tuple[list[tuple[int, float]], list[np.ndarray]]:
    """A balanced kd-tree of ``leaves`` (a power of two): (axis, value) per inner node in heap order, rows per leaf."""
    nodes, level = [], [np.arange(len(x))]
    while len(level) < leaves:
        below = []
        for rows in level:
            own = x[rows]
            axis = int(np.argmax(own.var(0))) if len(rows) else 0
            order = rows[np.argsort(own[:, axis], kind="stable")] if len(rows) else rows
            half = len(order) // 2
            nodes.append((axis, float(x[order[half], axis]) if len(order) else 0.0))
            below += [order[:half], order[half:]]
        level = below
    return nodes, level


def leaf_of(x: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf that each point falls into."""
    at = np.zeros(len(x), np.int64)
    axes, values = np.array([a for a, _ in nodes], np.int64), np.array([v for _, v in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[np.arange(len(x)), axes[at]] >= values[at])
    return at - len(nodes)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0.0) ** 2
    return out


# ---- search of one block ---------------------------------------------------
def _keep_best(best: np.ndarray, best_ids: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Merge scored candidates into the k best of their rows; equal scores go by id."""
    rows, k = np.unique(row), best.shape[1]
    row = np.concatenate([np.repeat(rows, k), row])
    score = np.concatenate([best[rows].ravel(), score])
    ids = np.concatenate([best_ids[rows].ravel(), ids])
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    best[rows], best_ids[rows] = score[first].reshape(-1, k), ids[first].reshape(-1, k)


def search(queries, query_ids, bound, vectors, ids, extra, turn, k: int, greatest: float, limit: float):
    """The k best of a block per query: (ids, scores), -1 and -inf where there are fewer.

    ``bound`` is the k-th best inner product a query already has (-inf if none).
    """
    n = len(vectors)
    leaves = 1 << max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
    points = vectors @ turn[:-1] + extra[:, None] * turn[-1]
    shadow = queries @ turn[:-1]
    _, members = kd_tree(points, leaves)
    members = [m for m in members if len(m)]
    low = np.array([points[m].min(0) for m in members])
    high = np.array([points[m].max(0) for m in members])
    far = box_distance(shadow, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    square = greatest * greatest + (queries * queries).sum(1)
    slack = 1e-12 * greatest * np.sqrt((queries * queries).sum(1))  # well over the rounding of a product
    active = np.arange(len(queries))
    for step in range(0, len(members), STEP):
        kth = np.maximum(best[active, -1], bound[active])
        distance = np.maximum(square[active] - 2 * kth, 0.0)
        next_leaf = order[active, step]
        active = active[far[active, next_leaf] <= limit * distance]
        if not len(active):
            break
        todo = order[active, step : step + STEP]
        for leaf in np.unique(todo):
            rows = active[(todo == leaf).any(1)]
            inside = members[leaf]
            # a product's last bits depend on its shape: it only tells what comes near the k-th place
            rough = queries[rows] @ vectors[inside].T
            rough[ids[inside][None, :] == query_ids[rows][:, None]] = -np.inf
            least = best[rows, -1]
            if len(inside) > k:
                least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
            i, j = np.nonzero((rough >= (least - slack[rows])[:, None]) & ~np.isneginf(rough))
            if len(i):
                # products added up one pair at a time, always in the same order
                score = (queries[rows[i]] * vectors[inside[j]]).sum(axis=1)
                _keep_best(best, best_ids, rows[i], score, ids[inside[j]])
    return best_ids, best


def _search_group(turn, k, greatest, limit):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vectors, queries = _matrix(held.column("vector")), _matrix(asked.column("vector"))
        ids = held.column("vec_id").to_numpy()
        query_ids = asked.column("query_id").to_numpy()
        found, score = search(
            queries, query_ids, asked.column("bound").to_numpy(), vectors, ids, _filled(vectors, greatest), turn.value, k, greatest, limit
        )
        keep = np.isfinite(score)
        return pa.table([pa.array(np.repeat(query_ids, keep.sum(1))), pa.array(found[keep]), pa.array(score[keep])], names=names)

    return run


def _placed_rows(turn, nodes, greatest, want_box: bool):
    """The block of each vector, by its projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            points = x @ turn.value[:-1] + _filled(x, greatest)[:, None] * turn.value[-1]
            block = leaf_of(points, nodes.value) if nodes.value else np.zeros(len(x), np.int64)
            if want_box:
                for b in np.unique(block):
                    own = points[block == b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b]), pa.array([own.min(0).tolist()]), pa.array([own.max(0).tolist()])], names=["block", "low", "high"]
                    )
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(block)], names=["vec_id", "vector", "block"])

    return run


def _visit_rows(turn, boxes, greatest, limit):
    """Blocks that a query still has to search, given its bound; its home block is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = boxes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            distance = np.maximum(greatest * greatest + (x * x).sum(1) - 2 * batch.column("bound").to_numpy(), 0.0)
            go = box_distance(x @ turn.value[:-1], low, high) <= limit * distance[:, None]
            go &= names[None, :] != batch.column("block").to_numpy()[:, None]
            row, block = np.nonzero(go)
            for at in range(0, len(row), 8192):
                r = pa.array(row[at : at + 8192])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(r), batch.column("vector").take(r), batch.column("bound").take(r), pa.array(names[block[at : at + 8192]])],
                    names=["query_id", "vector", "bound", "block"],
                )

    return run


def _visit(asked: DataFrame, placed: DataFrame, turn, k: int, greatest: float, limit: float) -> DataFrame:
    """Search blocks for the queries (query_id, vector, bound, block), some queries and one block at a time."""
    many = stage(asked.groupBy("block").agg(F.expr(f"1 + COUNT(*) DIV {CHUNK_ROWS} AS chunks")), "chunks")
    asked = asked.join(many, "block").selectExpr("query_id", "vector", "bound", "block", "pmod(xxhash64(query_id), chunks) AS chunk")
    held = placed.join(many, "block").selectExpr("vec_id", "vector", "block", "explode(sequence(0L, chunks - 1)) AS chunk")
    return asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInArrow(
        _search_group(turn, k, greatest, limit), "query_id bigint, vec_id bigint, score double"
    )


def nearest(
    vectors: DataFrame, queries: str, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by inner product found for each row that ``queries`` selects.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id. A
    query is no candidate of its own. Ties go to the smaller vec_id. Vectors that
    are null, empty, zero, of another width than the widest, or hold null, NaN or
    infinite components take no part, nor do rows without vec_id. Repeated rows
    count once. Fewer vectors than ``k`` give all; an empty table gives no rows;
    other columns are ignored. The fit of blocks sees about 20,000 rows; every
    row is indexed and can be found.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    clean = vectors.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS array<double>) AS vector").where(
        "vec_id IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x != 0)"
    ).dropDuplicates(["vec_id", "vector"])
    clean = stage(clean.withColumn("norm", F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + x * x))")), "vectors")
    facts = clean.agg(F.max(F.size("vector")).alias("width"), F.max("norm").alias("norm"), F.count("*").alias("n")).first()
    width, greatest, n = facts["width"] or 1, facts["norm"] or 1.0, facts["n"]
    clean = clean.where(f"size(vector) = {width}").drop("norm")
    turn = sc.broadcast(_projection(width, dims))
    limit = chi_square_quantile(confidence, dims)

    blocks = 1 << max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS))))
    nodes: list = []
    if blocks > 1:
        part = min(1 << 20, math.ceil((1 << 20) * SAMPLE_ROWS / n))
        sample = _matrix(clean.where(f"pmod(xxhash64(vec_id), {1 << 20}) < {part}").select("vector").toArrow().column("vector"))
        points = sample @ turn.value[:-1] + _filled(sample, greatest)[:, None] * turn.value[-1]
        nodes = kd_tree(points, blocks)[0]
    shared = sc.broadcast(nodes)
    placed = stage(clean.mapInArrow(_placed_rows(turn, shared, greatest, False), "vec_id bigint, vector array<double>, block bigint"), "placed")
    asked = stage(placed.where(queries).selectExpr("vec_id AS query_id", "vector", "block"), "queries")
    if queries and not n:
        return asked.selectExpr("query_id", "1 AS rank", "query_id AS vec_id", "0D AS score").limit(0)
    box = clean.mapInArrow(_placed_rows(turn, shared, greatest, True), f"block bigint, low array<double>, high array<double>")
    axes = ", ".join(f"min(low[{i}])" for i in range(dims)), ", ".join(f"max(high[{i}])" for i in range(dims))
    box = box.groupBy("block").agg(F.expr(f"array({axes[0]}) AS low"), F.expr(f"array({axes[1]}) AS high")).toArrow()
    names, low, high = box.column("block").to_numpy(), _matrix(box.column("low")), _matrix(box.column("high"))

    home = stage(_visit(asked.withColumn("bound", F.lit(float("-inf"))), placed, turn, k, greatest, limit), "home")
    kth = home.groupBy("query_id").agg(F.expr(f"IF(COUNT(*) >= {k}, min(score), double('-infinity')) AS bound"))
    bounded = asked.join(kth, "query_id", "left").selectExpr("query_id", "vector", "block", "COALESCE(bound, double('-infinity')) AS bound")
    away = bounded.mapInArrow(
        _visit_rows(turn, sc.broadcast((names, low, high)), greatest, limit), "query_id bigint, vector array<double>, bound double, block bigint"
    )
    found = home.unionByName(_visit(stage(away, "visits"), placed, turn, k, greatest, limit))
    best = found.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where(f"rank <= {k}")
    return best.selectExpr("query_id", "CAST(rank AS INT) AS rank", "vec_id", "score")
