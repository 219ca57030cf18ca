"""Gradient-boosted trees grown leaf by leaf over binned columns.

Columns are cut into at most 255 bins once; after that a row is a byte per
feature, its label and its raw score, held in blocks that stay on the
executors. A round sends the tree so far to the blocks and gets back, per new
leaf, the sums of gradient, Hessian and rows per feature and bin: some 40
kilobytes a leaf, however many rows there are. Only the smaller child of a
split is counted, its sibling is the parent less the child.

Leaves are split best gain first. As a leaf's gain is known only after its
histogram, one split at a time would take as many rounds as splits. So a bounded
sample of the rows foresees the whole tree, and one round counts all its leaves
over all rows. Splits that the full counts confirm stand, with all below them up
to the first that differs; from there the next round goes on. The sample decides
nothing: the tree is the one that full counts give, however bad the guess.

With more rows than the sample holds it often guesses wrong, and a round costs
more than what it counts. Two things save rounds then. A leaf that parted like
one of the tree before is first taken to split like it too. And small leaves
come to the driver whole, a bounded number of rows a tree, which counts what
lies below them without further rounds.

The blocks are an RDD because they are state that each tree changes in place of
rows to be queried. Each tree makes a new generation of raw scores out of the
one before; every ``CUT`` trees a checkpoint ends the lineage, so a lost
executor costs that many trees of its own blocks at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.exprs import double
from tallywatch.models.newton import PROBABILITY
from tallywatch.operators.ordering import running_totals
from tallywatch.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BINS = 255
MISSING = 255  # the bin of missing values
CUT = 20
FLAT = 64  # partitions up to which histograms are added up in one step
BLOCK_ROWS = 1 << 18
SAMPLE_ROWS = 1 << 18  # rows that the driver holds whole to foresee splits: 16 bytes each
SHARE_ROWS = 1 << 16  # the sample's rows where there are more
FETCHED_ROWS = 1 << 20  # rows of small leaves that come to the driver in a tree: 16 bytes each
_LEAST_HESSIAN = 1e-3

NODES = "tree int, node int, feature int, cut int, missing_left boolean, left int, right int, value double"
_DIRECTIONS = np.array([False, True])  # missing to the right, to the left


class Split(NamedTuple):
    gain: float
    feature: int
    cut: int
    missing_left: bool
    rows: tuple[int, int]


class Tree(NamedTuple):
    """Arrays by node; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


class Rules(NamedTuple):
    step: float = 0.08
    leaves: int = 31
    least_rows: int = 100
    penalty: float = 1.0


def bin_table(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, bin, low, high): the least and greatest value of each bin; the feature is its place in the list.

    Up to 255 different values have a bin each. With more, a value's bin is that
    of the share of rows below it, in 255ths. Exact, from running counts per value.
    """
    cells = ", ".join(f"struct({i} AS feature, nanvl({double(c)}, NULL) AS value)" for i, c in enumerate(features))
    points = (
        rows.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL")
        .groupBy("feature", "value").agg(F.expr("COUNT(*) AS n"), F.expr("1L AS one"))
    )
    counted = running_totals(points, ["value"], {"upto": "n", "place": "one"}, segments=["feature"])
    whole = counted.groupBy("feature").agg(F.expr("MAX(upto) AS rows"), F.expr("MAX(place) AS different"))
    return (
        counted.join(F.broadcast(whole), "feature")  # one row per feature
        .selectExpr("feature", "value", f"CASE WHEN different <= {BINS} THEN place - 1 ELSE (upto - n) * {BINS} div rows END AS bin")
        .groupBy("feature", "bin")
        .agg(F.expr("MIN(value) AS low"), F.expr("MAX(value) AS high"))
    )


def bin_edges(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Per feature the edges between bins, half way between neighbouring values."""
    edges: list[np.ndarray] = []
    found = bin_table(rows, features).toPandas().sort_values(["feature", "bin"])
    for i in range(len(features)):
        own = found[found.feature == i]
        low, high = own.low.to_numpy()[1:], own.high.to_numpy()[:-1]
        middle = high / 2 + low / 2
        edges.append(np.where((middle > high) & (middle < low), middle, high))
    return edges


def codes_of(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins as bytes, a row per feature."""
    out = np.empty((len(edges), len(columns[0]) if columns else 0), np.uint8)
    for i, (x, cuts) in enumerate(zip(columns, edges)):
        out[i] = np.where(np.isnan(x), MISSING, np.searchsorted(cuts, x, side="left"))
    return out


def _block_rows(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, label = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns)
            codes = codes_of(columns, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([codes.tobytes()], pa.binary()), pa.array([(label == 1).astype(np.uint8).tobytes()], pa.binary())], names=["codes", "label"]
            )

    return run


def parted(codes: np.ndarray, tree: Tree, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that end in each leaf."""
    held = {0: rows}
    for at in np.flatnonzero(tree.feature >= 0).tolist():  # parents stand before children
        here = held.pop(at)
        code = codes[tree.feature[at], here]
        left = code <= tree.cut[at]  # MISSING is greater than every cut
        if tree.missing_left[at]:
            left |= code == MISSING
        held[int(tree.left[at])], held[int(tree.right[at])] = here[left], here[~left]
    return held


def towards(tree: Tree, leaves: list[int]) -> Tree:
    """The tree with only the splits on the way to some leaves."""
    way = set(leaves)
    for at in reversed(range(len(tree.feature))):
        if tree.feature[at] >= 0 and way & {int(tree.left[at]), int(tree.right[at])}:
            way.add(at)
    return tree._replace(feature=np.where([at in way for at in range(len(tree.feature))], tree.feature, -1))


def leaves_of(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(codes.shape[1], np.int32)
    for leaf, rows in parted(codes, tree, np.arange(codes.shape[1])).items():
        out[rows] = leaf
    return out


def slopes(label: np.ndarray, raw: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss."""
    w = np.where(label == 1, weights[1], weights[0])
    p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
    return w * (p - label), w * p * (1 - p)


def summed(codes: np.ndarray, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and rows per feature and bin over some rows."""
    out = np.empty((len(codes), 256, 3))
    g, h = gradient[rows], hessian[rows]
    for i, own in enumerate(codes):
        key = own[rows].astype(np.intp)
        out[i, :, 0], out[i, :, 1] = np.bincount(key, g, 256), np.bincount(key, h, 256)
        out[i, :, 2] = np.bincount(key, minlength=256)
    return out


def histograms(blocks, tree: Tree, wanted: list[int], fetched: list[int], weights: tuple[float, float]) -> tuple[np.ndarray, list[tuple]] | None:
    """``summed`` per wanted leaf over all blocks, and the rows of the fetched ones, leaf by leaf; None without blocks."""
    total, rows, tree = None, [], towards(tree, [*wanted, *fetched])
    for codes, label, raw in blocks:
        held, (gradient, hessian) = parted(codes, tree, np.arange(len(label))), slopes(label, raw, weights)
        own = np.array([summed(codes, held[n], gradient, hessian) for n in wanted]).reshape(-1, len(codes), 256, 3)
        total = own if total is None else total + own
        rows += [(n, codes[:, held[n]], label[held[n]], raw[held[n]]) for n in fetched]
    return None if total is None else (total, rows)


def best_split(sums: np.ndarray, rules: Rules) -> Split | None:
    """The split of largest gain of a leaf's histogram; the first feature, direction and bin among equals."""
    whole, missing = sums[0].sum(axis=0), sums[:, MISSING]
    ways = _DIRECTIONS if missing.any() else _DIRECTIONS[:1]  # with nothing missing both are the same
    parts = np.ascontiguousarray(sums.transpose(2, 0, 1))
    left = np.cumsum(parts[..., :MISSING], axis=2)[:, :, None] + ways[:, None] * parts[..., None, MISSING:]
    right = whole[:, None, None, None] - left
    gain = left[0] ** 2 / (left[1] + rules.penalty)
    gain += right[0] ** 2 / (right[1] + rules.penalty)
    gain -= whole[0] ** 2 / (whole[1] + rules.penalty)
    allowed = (np.minimum(left[2], right[2]) >= max(1, rules.least_rows)) & (np.minimum(left[1], right[1]) >= _LEAST_HESSIAN)
    gain[~allowed] = 0
    at = int(gain.argmax())
    if not gain.flat[at] > 0:
        return None
    f, direction, cut = np.unravel_index(at, gain.shape)
    rows = left[2, f, direction, cut], right[2, f, direction, cut]
    to_left = bool(direction) if missing[f, 2] else rows[0] >= rows[1]  # never seen: with most rows
    return Split(float(gain.flat[at]), int(f), int(cut), to_left, tuple(map(int, rows)))


def same_way(node: int, one: dict[int, Split | None], other: dict[int, Split | None]) -> bool:
    """Whether two trees part the rows alike on the way to a node."""
    return all(one.get(n) and other.get(n) and one[n][1:4] == other[n][1:4] for n in (node >> k for k in range(1, node.bit_length())))


class Growth:
    """A tree that grows best leaf first. Nodes are numbered by path: 1 is the root, 2n and 2n + 1 are the children of n."""

    def __init__(self, rules: Rules, split: dict[int, Split | None] | None = None, sums: dict[int, np.ndarray] | None = None):
        self.rules, self.split, self.sums = rules, dict(split or {}), dict(sums or {})

    def chosen(self) -> list[int]:
        """Nodes that best-first growth splits, as far as gains are known."""
        open_, order = [(-self.split[1].gain, 1)] if self.split.get(1) else [], []
        while open_ and len(order) < self.rules.leaves - 1:
            _, best = heappop(open_)
            order.append(best)
            for n in (2 * best, 2 * best + 1):
                if s := self.split.get(n):
                    heappush(open_, (-s.gain, n))
        return order

    def wanted(self) -> list[int]:
        """Leaves to count next, one of a pair of siblings; none when the tree is done."""
        if 1 not in self.split:
            return [1]
        order = self.chosen()
        out = []
        for n in order if len(order) < self.rules.leaves - 1 else order[:-1]:  # behind the last split nothing is split
            rows, pair = self.split[n].rows, (2 * n, 2 * n + 1)
            for child, count in zip(pair, rows):
                if count < 2 * max(1, self.rules.least_rows):
                    self.split.setdefault(child, None)
            if any(c not in self.split for c in pair):
                out.append(pair[rows[0] > rows[1]])
        return out

    def add(self, node: int, own: np.ndarray) -> None:
        """Take a leaf's histogram; that of its sibling is the rest of the parent's."""
        self.sums[node] = own
        self.split.setdefault(node, best_split(own, self.rules))
        if node > 1:
            self.sums[node ^ 1] = self.sums[node // 2] - own
            self.split.setdefault(node ^ 1, best_split(self.sums[node ^ 1], self.rules))

    def take(self, found: dict[int, np.ndarray], guess: Growth) -> None:
        """Histograms of leaves of another tree count as far as that tree's splits turn out to be right."""
        while True:
            right = [
                c for n in self.wanted() for c in {n, n ^ 1 if n > 1 else n}
                if c in found and same_way(c, self.split, guess.split)
            ]
            for c in right:
                if c not in self.sums:
                    self.add(c, found[c])
            if not right:
                return

    def splits(self) -> list[int]:
        return [n for n, s in self.split.items() if s and n in self.sums]

    def count(self, held: dict[int, np.ndarray], codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, share: float = 1.0, last: dict[int, Split | None] | None = None) -> None:
        """Grow on below the leaves whose rows are held; with a ``last`` tree one best leaf at a time, and by its splits where it parted alike."""
        while mine := [n for n in self.wanted() if n in held or n // 2 in held]:
            for n in mine if last is None else mine[:1]:
                if n > 1 and n not in held:  # the parent's rows are not parted yet
                    one = self.split[n // 2]
                    here = held.pop(n // 2)
                    code = codes[one.feature, here]
                    left = (code <= one.cut) | (one.missing_left & (code == MISSING))
                    held[n & ~1], held[n | 1] = here[left], here[~left]
                self.add(n, summed(codes, held[n], gradient, hessian) / share)
                for c in {n, n ^ 1 if n > 1 else n} if last else ():
                    if self.split[c] and last.get(c) and same_way(c, self.split, last):
                        self.split[c] = last[c]

    def foreseen(self, codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, share: float, last: dict[int, Split | None] | None = None) -> Growth:
        """The tree as the sample, and the splits of the last tree, would grow it from here."""
        ahead = Growth(self.rules, self.split, self.sums)
        tree, number = ahead.tree(ahead.splits())
        node = {at: n for n, at in number.items()}
        held = {node[at]: rows for at, rows in parted(codes, tree, np.arange(len(gradient))).items()}
        ahead.count(held, codes, gradient, hessian, share, last)
        return ahead

    def small(self, most: int) -> list[int]:
        """Nodes above leaves to count, those with fewest rows first, up to so many rows."""
        size = {n // 2: sum(self.split[n // 2].rows) for n in self.wanted() if n > 1}
        order = sorted(size, key=lambda n: (size[n], n))
        return [n for n, upto in zip(order, np.cumsum([size[n] for n in order])) if upto <= most]

    def tree(self, kept: list[int], values: bool = False) -> tuple[Tree, dict[int, int]]:
        """The kept splits as arrays, and the place of each node in them; parents stand before children."""
        nodes = sorted({1} | {c for n in kept for c in (2 * n, 2 * n + 1)})
        number = {n: i for i, n in enumerate(nodes)}
        size = len(nodes)
        out = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size, bool), np.zeros(size, int), np.zeros(size, int), np.zeros(size))
        for n in kept:
            s, at = self.split[n], number[n]
            out.feature[at], out.cut[at], out.missing_left[at] = s.feature, s.cut, s.missing_left
            out.left[at], out.right[at] = number[2 * n], number[2 * n + 1]
        if values:
            for n, at in number.items():
                if out.feature[at] < 0:
                    g, h = self._totals(n)
                    out.value[at] = -self.rules.step * g / (h + self.rules.penalty)
        return out, number

    def _totals(self, node: int) -> tuple[float, float]:
        if node in self.sums:
            return tuple(self.sums[node][0].sum(axis=0)[:2])
        s = self.split[node // 2]
        own = self.sums[node // 2][s.feature]
        left = own[: s.cut + 1].sum(axis=0) + s.missing_left * own[MISSING]
        return tuple((own.sum(axis=0) - left if node % 2 else left)[:2])


def _counted(
    state: RDD, tree: Tree, wanted: list[int], weights: tuple[float, float], used: np.ndarray, fetched: list[int] = []
) -> tuple[np.ndarray, list[tuple]]:
    """``histograms`` over all blocks; only bins in use travel."""

    def run(blocks):
        found = histograms(blocks, tree, wanted, fetched, weights)
        return [] if found is None else [(found[0][:, used], found[1])]

    parts = state.mapPartitions(run)
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    out = np.zeros((len(wanted), *used.shape, 3))
    out[:, used], rows = parts.reduce(add) if state.getNumPartitions() <= FLAT else parts.treeReduce(add)
    return out, rows


def _used(edges: list[np.ndarray]) -> np.ndarray:
    bins = np.arange(256)
    return np.stack([(bins <= len(cuts)) | (bins == MISSING) for cuts in edges])


def grow(
    state: RDD, weights: tuple[float, float], rules: Rules, used: np.ndarray, sample, share: float, last: dict[int, Split | None] = {}
) -> tuple[Tree, dict[int, Split | None]]:
    """A tree, and its splits by node for the next one to try; ``last`` are those of the tree before."""
    growth = Growth(rules)
    codes, label, raw = sample
    gradient, hessian = slopes(label, raw, weights)  # a tree's rounds share them
    here, held, whole, left = (codes[:, :0], gradient[:0], hessian[:0]), {}, set(), FETCHED_ROWS if share < 1 else 0
    while growth.wanted():
        guess = growth.foreseen(codes, gradient, hessian, share, last if share < 1 else None)
        near = growth.small(left)
        whole.update(near)
        likely = guess.splits() if share == 1 else {*guess.chosen(), *growth.chosen()}  # fewer leaves to count and to send
        tree, number = guess.tree([n for n in likely if not whole.intersection(n >> k for k in range(n.bit_length()))])
        asked = [n for n, at in number.items() if tree.feature[at] < 0 and n not in growth.sums]
        sums, rows = _counted(state, tree, [number[n] for n in asked], weights, used, [number[n] for n in near])
        found: dict[int, np.ndarray] = {}
        for n, own in zip(asked, sums):
            while n and n not in growth.sums:  # a leaf counts for all above it
                found[n] = found[n] + own if n in found else own
                n //= 2
        growth.take(found, guess)
        for n in near:
            own, labels, scores = (np.concatenate(x, axis=-1) for x in zip(*[r[1:] for r in rows if r[0] == number[n]]))
            held[n] = np.arange(len(labels)) + len(here[1])
            left -= len(labels)
            here = tuple(np.concatenate(x, axis=-1) for x in zip(here, (own, *slopes(labels, scores, weights))))
        growth.count(held, *here, last={})
    return growth.tree(growth.chosen(), values=True)[0], growth.split


def _raised(tree: Tree):
    return lambda block: (block[0], block[1], block[2] + tree.value[leaves_of(block[0], tree)])


@dataclass
class BoostedTrees:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    def raw(self, columns: list[np.ndarray]) -> np.ndarray:
        codes = codes_of(columns, self.edges)
        out = np.zeros(codes.shape[1])
        for tree in self.trees:
            out += tree.value[leaves_of(codes, tree)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with the probability of the label 1; missing features go where their rows went in the fit."""
        held = df.sparkSession.sparkContext.broadcast((self.edges, self.trees))  # some kilobytes a tree

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            raw = BoostedTrees([], *held.value).raw([c.to_numpy(np.float64) for c in columns])
            return pd.Series(1 / (1 + np.exp(-np.clip(raw, -700, 700))))

        return df.withColumn(PROBABILITY, probability(*[F.expr(double(c)) for c in self.features]))

    def save(self, spark: SparkSession, path: str) -> str:
        """Two small tables: nodes and edges."""
        nodes = {name: np.concatenate([getattr(t, name) for t in self.trees]) for name in Tree._fields} if self.trees else {n: np.zeros(0) for n in Tree._fields}
        sizes = [len(t.feature) for t in self.trees]
        table = pa.table({"tree": np.repeat(np.arange(len(sizes)), sizes), "node": np.concatenate([np.zeros(0, int), *map(np.arange, sizes)]), **nodes})
        spark.createDataFrame(table.to_pandas()).selectExpr(
            *[f"CAST({c} AS {kind}) AS {c}" for c, kind in (x.strip().split() for x in NODES.split(","))]
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, name, cuts.tolist()) for i, (name, cuts) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(rows, "place int, feature string, edges array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
        return path


def load_trees(spark: SparkSession, path: str) -> BoostedTrees:
    edges = sorted(spark.read.parquet(f"{path}/edges").collect())
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    trees = [Tree(*(own[name].to_numpy() for name in Tree._fields)) for _, own in nodes.groupby("tree")]
    return BoostedTrees([r["feature"] for r in edges], [np.array(r["edges"], np.float64) for r in edges], trees)


def _state(rows: DataFrame, features: list[str], edges: list[np.ndarray], label: str) -> RDD:
    """Blocks of (bins, labels, raw scores of 0)."""
    narrow = rows.selectExpr(*[f"{double(c)} AS {c}" for c in features], f"CAST({label} AS INT) AS {label}")
    blocks = narrow.mapInArrow(_block_rows(edges), "codes binary, label binary")
    n = len(features)

    def opened(row):
        label = np.frombuffer(row["label"], np.uint8)
        return np.frombuffer(row["codes"], np.uint8).reshape(n, -1), label, np.zeros(len(label))

    return blocks.rdd.map(opened)


def _joined(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """The same rows in blocks of ``BLOCK_ROWS`` or a little more."""
    held, rows = [], 0
    for block in blocks:
        held.append(block)
        rows += len(block[1])
        if rows >= BLOCK_ROWS:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))


def fit_trees(
    train: DataFrame, features: list[str], weights: tuple[float, float], iterations: int, rules: Rules = Rules(), label: str = "isFraud", seed: int = 42
) -> BoostedTrees:
    """``iterations`` trees on rows with a label; ``weights`` are those of the classes 0 and 1."""
    sc = train.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(train.sparkSession))
    rows = train.where(f"{label} IS NOT NULL")
    edges = bin_edges(rows, features)
    state = _state(rows, features, edges, label).persist(StorageLevel.MEMORY_AND_DISK)
    count = state.map(lambda block: len(block[1])).sum()
    share = 1.0 if count <= SAMPLE_ROWS else min(SAMPLE_ROWS, SHARE_ROWS) / count
    if share < 1:  # a job over few tasks with large blocks is shorter
        few = state.coalesce(min(state.getNumPartitions(), max(sc.defaultParallelism, state.getNumPartitions() // 8)))
        small, state = state, few.mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        small.unpersist()
    taken = _state(rows.sample(share, seed) if share < 1 else rows, features, edges, label).collect()
    sample = (
        tuple(np.concatenate(x, axis=-1) for x in zip(*taken)) if taken
        else (np.zeros((len(features), 0), np.uint8), np.zeros(0, np.uint8), np.zeros(0))
    )
    trees: list[Tree] = []
    before, last = None, {}
    for t in range(iterations if count else 0):
        tree, last = grow(state, weights, rules, _used(edges), sample, share, last)
        trees.append(tree)
        if before is not None:
            before.unpersist()
        if (trees[-1].feature < 0).all():
            break  # no split helps; nor would any later one
        sample = _raised(trees[-1])(sample)
        before, state = state, state.map(_raised(trees[-1])).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CUT == 0:
            state.checkpoint()
    state.unpersist()
    return BoostedTrees(features, edges, trees)


def first_splits(train: DataFrame, features: list[str], weights: tuple[float, float], rules: Rules = Rules(), label: str = "isFraud") -> DataFrame:
    """(Feature, Bins, Threshold, Gain): the best split of all rows on each feature alone, as the first tree weighs it."""
    known = train.where(f"{label} IS NOT NULL")
    edges = bin_edges(known, features)
    sums = _counted(_state(known, features, edges, label), Growth(rules).tree([])[0], [0], weights, _used(edges))[0][0]
    rows = []
    for i, name in enumerate(features):
        s = best_split(sums[i : i + 1], rules)
        rows.append((name, len(edges[i]) + 1, float(edges[i][s.cut]) if s and s.cut < len(edges[i]) else None, s.gain if s else None))
    return train.sparkSession.createDataFrame(rows, "Feature string, Bins int, Threshold double, Gain double")
