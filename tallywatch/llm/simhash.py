"""SimHash near-duplicates by exact comparison of fingerprint tiles.

A fingerprint's bit is set if it is set in over half of the 64-bit hashes of a
text's shingles. Two fingerprints link if they differ in at most ``radius`` bits.

Equal fingerprints are one node. Nodes are sorted into cells by the population
counts of their two halves (33 * 33 cells at most) and cut into tiles of about
``TILE`` nodes. The counts of two fingerprints of distance d differ by d at most,
both halves taken together, so only tiles of cells within the radius meet, which
leaves about a quarter of all tile pairs; each of these is compared in full by
exclusive-or and bit counts. The work still grows with the square of the number
of different fingerprints; it is dealt over as many partitions as comparisons
ask for.

Tile pairs return no pairs of nodes but a forest: each linked node with the
smallest node it reaches inside the two tiles. A group of m near copies so
gives at most m rows per tile pair, and components follow from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import signed, stage, word_pieces
from tallywatch.llm.components import components

SEED = 42
TILE = 4096
ROWS = 64  # rows of a tile that are compared at a time
COMPARISONS = 1 << 27  # aimed at per partition


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by blanks."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    joined, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, end[: n - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, end[size - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, size: int) -> tuple[int, int]:
    """(fingerprint, number of shingles) of a text with A-Z in lower case; zero without words."""
    bits, n, before = np.zeros(64, np.int64), 0, []
    for words in word_pieces(b"" if text is None else text.encode().lower()):
        words = before + words
        hashes = shingle_hashes(words, size)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        before = words[max(0, len(words) - size + 1) :]
    if not n and before:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED), 1
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]), n


def _fingerprint_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), size) for t in batch.column("text")]
            prints = signed(np.array([f for f, _ in found], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "print", "n_shingles"]
            )

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, print (64 bits as a bigint) and n_shingles for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_rows(size), f"doc_id {kind}, print bigint, n_shingles bigint")


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest members) after links a-b; ``root`` holds the roots before."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two tiles, or inside one: linked nodes and their roots."""
    nodes = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    root = np.arange(len(nodes))
    for at in range(0, len(left), ROWS):
        near = np.bitwise_count(left[at : at + ROWS, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i) and right is not None or len(i) > near.shape[0]:  # a node meets itself in its own tile
            root = join_roots(root, i + at, j + shift)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _link_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values for c in ("left", "right"))
                a, b = tile_links(*(None if x is None else x.to_numpy().view(np.uint64) for x in (left, right)), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Forest (a, b) that joins the different values of ``print`` that link, over any number of steps."""
    spark = prints.sparkSession
    nodes = prints.selectExpr("print", "CAST(bit_count(print & 4294967295L) AS INT) AS low", "CAST(bit_count(shiftrightunsigned(print, 32)) AS INT) AS high")
    # 33 * 33 cells at most, whatever the input
    cells = {(r["low"], r["high"]): r["n"] for r in nodes.groupBy("low", "high").agg(F.count("*").alias("n")).collect()}
    if not cells:
        return spark.createDataFrame([], "a bigint, b bigint")
    parts = {c: -(-n // TILE) for c, n in cells.items()}
    near = [
        (*c, parts[c], *d, parts[d])
        for c in cells
        for d in ((c[0] + x, c[1] + y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0))
        if d in cells
    ]
    work = sum(cells[n[0], n[1]] * cells[n[3], n[4]] for n in near)
    counts = spark.createDataFrame([(*c, p) for c, p in parts.items()], "low int, high int, parts int")
    tiles = stage(
        nodes.join(F.broadcast(counts), ["low", "high"])
        .groupBy("low", "high", F.expr("CAST(pmod(xxhash64(print), parts) AS INT) AS part"))
        .agg(F.collect_list("print").alias("prints")),  # about TILE values, for their number of parts is known
        "tiles",
    )
    pairs = (
        spark.createDataFrame(near, "low int, high int, parts int, low2 int, high2 int, parts2 int")
        .selectExpr("low", "high", "low2", "high2", "parts2", "explode(sequence(0, parts - 1)) AS part")
        .selectExpr("*", "explode(sequence(IF(low = low2 AND high = high2, part, 0), parts2 - 1)) AS part2")
        .selectExpr("low", "high", "part", "low2", "high2", "part2", "low = low2 AND high = high2 AND part = part2 AS one")
        .selectExpr("*", "xxhash64(low, high, part, low2, high2, part2) AS pair")
    )
    n = max(1, min(100_000, work // COMPARISONS))
    ids = ["low", "high", "part", "low2", "high2", "part2"]
    left = pairs.join(tiles, ["low", "high", "part"]).select(*ids, "pair", "one", F.col("prints").alias("left")).repartition(n, "pair")
    right = (
        pairs.where("NOT one").join(tiles.selectExpr("low AS low2", "high AS high2", "part AS part2", "prints AS right"), ["low2", "high2", "part2"])
        .select(*ids, "pair", "right").repartition(n, "pair")
    )
    return left.join(right, ["pair", *ids], "left").select("left", "right").mapInArrow(_link_rows(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, print, n_shingles and component_id for each row of ``docs``.

    Words are runs of anything but ASCII blanks, A-Z in lower case. Fewer words
    than ``size`` are one shingle; null and blank texts have the fingerprint 0,
    which links like any other. ``component_id`` is the smallest doc_id that
    links reach, the document's own included; null ids are passed over. Repeated
    rows are kept and link with each other; an empty table gives no rows; other
    columns are ignored.
    """
    prints = stage(fingerprints(docs, size), "fingerprints")
    first = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "different_fingerprints")
    groups = components(links(first.select("print"), radius))
    least = groups.join(first, F.col("node") == F.col("print")).groupBy("label").agg(F.min("first").alias("least"))
    ids = first.join(groups.join(least, "label").select(F.col("node").alias("print"), "least"), "print", "left").selectExpr(
        "print", "COALESCE(least, first) AS component_id"
    )
    return prints.join(ids, "print", "left").select("doc_id", "print", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns; null ids stay."""
    later = near_duplicates(docs, size, radius).where("component_id < doc_id").select("doc_id").distinct()
    return docs.alias("d").join(later.alias("l"), F.expr("d.doc_id = l.doc_id"), "left_anti")
