"""N-gram Jaccard join of documents: size-aware, heavy and light.

A document's set is that of its distinct word shingles. Two sets of similarity
``t`` share at least k of their first ``n - ceil(t n) + k`` members in any common
order. The order here puts rare shingles first: shingles are counted over all
documents in 2**22 buckets (a table of fixed size), and order is by the
bucket's frequency class, then by hash.

* Light sets (few shingles) enumerate the pairs of that prefix for k = 2: two
  similar light sets share one of these fixed-size subsets.
* Heavy sets use k = 1: single shingles, whose inverted lists are scanned. Light
  sets just below the boundary stand in these lists too, for heavy partners.
* The boundary is the size at which the two costs, summed over the histogram of
  set sizes, are least.

Copies (equal sets) are one node from the start. A list of m nodes is not
expanded into m * m pairs: all members are compared with one pivot, nodes found
linked become one component, and only members that are still in different
components go on, after some pivots by all their remaining pairs. Before that,
members leave the lists where, by size and by 256 bits (of which each shingle
turns one over), no other member can be similar to them. Every candidate is
verified exactly on the documents' whole shingle sets, so no link between
different components is lost. Before texts are fetched, an upper bound of the
shared shingles rules out most candidates: the sum over 256 hash classes of the
smaller of the two sets' counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import SPACE, bitmap, hash_words, in_bitmap, in_bitmap_rows, lowered, mix, shingles, signed, stage, text_parts
from tallywatch.llm.components import components

BUCKET_BITS = 22
BLOCK = 1 << 16  # buckets that travel together
MERGE = 512  # tasks whose counts are added up in one group
BITMAP_BITS = 25
SCAN_COST = 4  # reading a list entry, in units of writing one
PIVOT_ROUNDS = 3
PIVOTS = 8  # pivots of a list in each round after the first
SKETCH = 16  # keys of a node that tell whether a pair stands in an earlier list too
CLASSES = 256
KEYS_HELD = 1 << 16  # keys of a task that are handed over at a time
NODES_HELD = 1 << 14  # nodes of a task that are known to have handed over theirs
BLOCK_NODES = 1_000  # nodes of a list that are paired with each other in one task
GROUP_ROWS = 500  # members that are compared with a pivot in one task


def _sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) per text; texts with fewer words are one shingle, texts without none."""
    for first, last, hashes, offsets in hash_words(texts, SPACE):
        for i in range(last - first):
            words = hashes[offsets[i] : offsets[i + 1]]
            yield first + i, np.unique(shingles(words, min(size, len(words)))) if len(words) else words


def _fingerprint(members: np.ndarray) -> int:
    """An id of the set: equal sets have equal ids."""
    with np.errstate(over="ignore"):
        total = mix(members + np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(members))
    return int(signed(mix(np.array([total])))[0])


def _node_rows(size: int):
    """doc_id, n, node, profile per document; at the end the task's bucket counts, a packed block per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        kind, task = None, 0
        names = ["doc_id", "n", "node", "profile", "task", "block", "counts"]
        for batch in text_parts(batches, "text"):
            ids, n, node, profile = batch.column("doc_id"), [], [], []
            kind = ids.type
            if batch.num_rows:
                task = batch.column("task")[0].as_py()
            for _, members in _sets(lowered(batch.column("text")), size):
                n.append(len(members))
                node.append(_fingerprint(members))
                spread = np.bincount((members & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                profile.append(np.minimum(spread, 255).astype(np.uint8).tobytes())
                np.add.at(counts, _bucket(members), 1)
            empty = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(profile, pa.binary()), *empty], names=names
            )
        blocks = [k for k in range(0, len(counts), BLOCK) if counts[k : k + BLOCK].any()]
        if blocks:
            nothing = pa.nulls(len(blocks), pa.int64())
            packed = [zlib.compress(counts[k : k + BLOCK].tobytes(), 1) for k in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(blocks), kind), nothing, nothing, pa.nulls(len(blocks), pa.binary()), pa.array([task] * len(blocks), pa.int32()),
                    pa.array([k // BLOCK for k in blocks], pa.int32()), pa.array(packed, pa.binary()),
                ],
                names=names,
            )

    return run


def _bucket(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _add_blocks(group: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint64)
    for packed in group.column("counts"):
        raw = zlib.decompress(packed.as_py())
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * BLOCK else np.uint64)
    return pa.table(
        {
            "task": pa.array([group.column("task")[0].as_py()], pa.int32()),
            "block": pa.array([group.column("block")[0].as_py()], pa.int32()),
            "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()),
        }
    )


def _rarity(made: DataFrame) -> np.ndarray:
    """Frequency class per bucket over all documents: added up in groups of tasks, then per block."""
    kind = "task int, block int, counts binary"
    once = made.where("block IS NOT NULL").selectExpr(f"task DIV {MERGE} AS task", "block", "counts").selectExpr("CAST(task AS INT) AS task", "block", "counts")
    some = once.groupBy("task", "block").applyInArrow(_add_blocks, kind)
    all_of = some.groupBy("block").applyInArrow(_add_blocks, kind).toArrow()  # 64 rows
    count = np.zeros(1 << BUCKET_BITS, np.float32)
    for block, packed in zip(all_of.column("block").to_pylist(), all_of.column("counts")):
        count[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(packed.as_py()), np.uint64)
    middle = max(1.0, float(np.median(count)))
    out = np.zeros(len(count), np.uint8)
    for k in range(0, len(count), BLOCK):  # a block at a time: the driver's memory is small
        out[k : k + BLOCK] = np.clip(np.floor(4 * np.log2(np.maximum(count[k : k + BLOCK], 1) / middle)), 0, 255)
    return out


def _keys(members: np.ndarray, rank: np.ndarray, percent: int, boundary: int) -> np.ndarray:
    """Keys under which a set is looked up."""
    n = len(members)
    spare = n - -(-percent * n // 100)
    if not spare and percent * (n + 1) > 100 * n:  # such a set has only equal partners
        return members[:0]
    order = np.lexsort((members, rank[_bucket(members)]))
    keys = []
    if n <= boundary:
        head = members[order[: spare + 2]]
        a, b = np.triu_indices(len(head), 1)
        pair = np.sort(np.column_stack([head[a], head[b]]), axis=1)
        keys.append(mix(pair[:, 0] * np.uint64(0x9E3779B97F4A7C15) + pair[:, 1]))
    if 100 * n > percent * boundary:
        keys.append(members[order[: spare + 1]])
    return np.concatenate(keys)


def _parity(members: np.ndarray) -> np.ndarray:
    """256 bits, of which each member turns one over: no more bits of two sets differ than members."""
    odd = np.bincount((members & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _key_rows(size: int, percent: int, boundary: int, rank, only):
    """(key, node) per document, at most once per key and stretch of documents.

    With ``only``, a bitmap of keys, those alone, and n and the parity of the set.
    """

    def rows(found: list) -> pa.RecordBatch:
        keys, nodes, sizes, parities = zip(*found)
        lengths = [len(k) for k in keys]
        columns = {"key": signed(np.concatenate(keys)), "node": np.repeat(np.array(nodes, np.int64), lengths)}
        if only:
            bits = np.repeat(np.stack(parities), lengths, axis=0)
            columns |= {"n": np.repeat(np.array(sizes, np.int64), lengths)} | {f"bits{k}": np.ascontiguousarray(bits[:, k]) for k in range(4)}
        return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = rank.value, only.value if only else None
        found, held, seen = [], 0, set()
        for batch in text_parts(batches, "text"):
            for _, members in _sets(lowered(batch.column("text")), size):
                node = _fingerprint(members)
                if not len(members) or node in seen:
                    continue
                if len(seen) >= NODES_HELD:
                    seen.clear()
                seen.add(node)
                keys = _keys(members, ranks, percent, boundary)
                if table is not None:
                    keys = keys[in_bitmap(keys, table)]
                if not len(keys):
                    continue
                found.append((keys, node, len(members), _parity(members) if only else None))
                held += len(keys)
                if held > KEYS_HELD:  # the keys of a batch are many times its texts
                    yield rows(found)
                    found, held = [], 0
        if held:
            yield rows(found)

    return run


def choose_boundary(sizes: list[tuple[int, int]], percent: int) -> int:
    """The set size up to which enumerating subsets costs less than scanning lists, from (size, sets)."""
    n = np.array([s for s, _ in sizes], np.int64)
    many = np.array([c for _, c in sizes], np.int64)
    if not len(n):
        return 0
    spare = n - -(-percent * n // 100)
    subsets = (spare + 2) * (spare + 1) // 2
    scans = (spare + 1) * (1 + SCAN_COST)
    best = min(
        (int((many * subsets)[n <= x].sum() + (many * scans)[100 * n > percent * x].sum()), x)
        for x in [0, *range(6, 400)]
    )
    return best[1]


# ---- candidates and their verification -------------------------------------
def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the upper bound of the shared members, from the profiles, allows a link."""
    most = np.minimum(a, b).sum(-1, dtype=np.int64)
    most = np.where(((a == 255) & (b == 255)).any(-1), n + m, np.minimum(most, np.minimum(n, m)))  # full counters say nothing
    return (100 + percent) * most >= percent * (n + m)


def _profiles(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), CLASSES)


def _likely_rows(percent: int):
    """Pairs that the profiles allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _may_link(
                _profiles(batch.column("pa")), _profiles(batch.column("pb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent
            )
            yield batch.select(["pivot", "node"]).filter(pa.array(keep))

    return run


def _sketches(column) -> np.ndarray:
    """Least keys per node, filled up with the greatest number."""
    keys = column.combine_chunks()
    sizes = keys.value_lengths().to_numpy()
    out = np.full((len(sizes), SKETCH), np.iinfo(np.int64).max)
    out[np.arange(SKETCH) < sizes[:, None]] = keys.flatten().to_numpy()
    return out


def _pair_block(percent: int):
    """All pairs between two blocks of a list (or within one) whose sizes, components and profiles allow a link.

    Near copies stand in many lists together. A pair is left to the list of the
    least key that both nodes' sketches hold; without one every list makes it.
    """

    def run(group: pa.Table) -> pa.Table:
        node, n, label = (group.column(c).to_numpy() for c in ("node", "n", "label"))
        profile, share = _profiles(group.column("profile")), group.column("share").to_numpy()
        low, high, key = (group.column(c)[0].as_py() for c in ("low", "high", "key"))
        sketch = _sketches(group.column("sketch"))
        left, right = np.flatnonzero(share == low), np.flatnonzero(share == high)
        one, two = [], []
        for at in range(0, len(left), 128):
            some = left[at : at + 128]
            x, y = some[:, None], right[None, :]
            fits = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            if low == high:
                fits &= node[x] < node[y]
            i, j = np.nonzero(fits)
            i, j = some[i], right[j]
            for k in range(0, len(i), 8192):
                p, q = i[k : k + 8192], j[k : k + 8192]
                earlier = ((sketch[p][:, :, None] == sketch[q][:, None, :]) & (sketch[p] < key)[:, :, None]).any((1, 2))
                p, q = p[~earlier], q[~earlier]
                keep = _may_link(profile[p], profile[q], n[p], n[q], percent)
                one.append(node[p[keep]])
                two.append(node[q[keep]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        return pa.table({"pivot": pa.array(np.minimum(a, b)), "node": pa.array(np.maximum(a, b))})

    return run


def _verify(size: int, percent: int):
    """Links between a pivot and the members of its group. Rows carry whole texts."""

    def run(group: pa.Table) -> pa.Table:
        pivot, nodes = group.column("pivot")[0].as_py(), group.column("node").to_pylist()
        texts = lowered(group.column("text"))
        order = sorted(range(len(nodes)), key=lambda i: nodes[i] != pivot)  # the pivot's own text first
        own, links, seen = None, [], set()
        for row, members in _sets([texts[i] for i in order], size):
            node = nodes[order[row]]
            if node in seen or _fingerprint(members) != node:  # another text with the same document id
                continue
            seen.add(node)
            if node == pivot:
                own = members
                continue
            if own is None:
                break
            at = np.minimum(np.searchsorted(own, members), len(own) - 1)
            both = int((own[at] == members).sum())
            if 100 * both >= percent * (len(own) + len(members) - both):
                links.append(node)
        return pa.table({"a": pa.array([pivot] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return run


def _links(docs: DataFrame, pairs: DataFrame, homes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (pivot, node) that are similar. ``homes`` names a document of each node."""
    many = pairs.groupBy("pivot").agg(F.count("*").alias("members"))
    salted = pairs.join(many, "pivot").selectExpr(
        "pivot", "node", f"pmod(xxhash64(node), 1 + members DIV {GROUP_ROWS}) AS share"
    )
    wanted = salted.unionByName(salted.selectExpr("pivot", "pivot AS node", "share").distinct())
    wanted = stage(wanted.join(homes, "node").select("pivot", "share", "node", "doc_id", F.xxhash64("doc_id").alias("id_hash")), "wanted")
    texts = in_bitmap_rows(
        docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash")), "id_hash",
        bitmap(wanted.select("id_hash").distinct(), "id_hash", BITMAP_BITS),
    )
    return (
        wanted.drop("id_hash").alias("w").join(texts.drop("id_hash").alias("t"), F.expr("w.doc_id <=> t.doc_id"))
        .select("pivot", "share", "node", "text")
        .groupBy("pivot", "share")
        .applyInArrow(_verify(size, percent), "a bigint, b bigint")
    )


def _with_partner(lists: DataFrame, percent: int) -> DataFrame:
    """key, node, n of members whose list holds another one that size and parity allow to be similar.

    Unrelated texts meet in ever more lists as a corpus grows; nearly all of them
    end here, before any pair is made. Long lists are cut into blocks that meet
    two at a time.
    """
    counted = lists.groupBy("key").agg(F.expr(f"1 + COUNT(*) DIV {BLOCK_NODES} AS blocks"))
    spread = (
        lists.join(counted, "key")
        .selectExpr("*", "pmod(xxhash64(node), blocks) AS share", "explode(sequence(0L, blocks - 1)) AS other")
        .selectExpr("*", "least(share, other) AS low", "greatest(share, other) AS high")
    )
    differ = " + ".join(f"bit_count(x.bits{k} ^ y.bits{k})" for k in range(4))  # n + n - 2 * shared members at most
    match = f"""x.key = y.key AND x.low = y.low AND x.high = y.high AND x.node != y.node
        AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"""
    return spread.alias("x").join(spread.alias("y"), F.expr(match), "left_semi").select("key", "node", "n").distinct()


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id per document row.

    Words are runs of characters other than ASCII white space, A-Z in lower
    case. Two documents link when ``100 * shared >= percent * united`` over
    their distinct shingles; ``component_id`` is the smallest doc_id reachable.

    A text of fewer words than ``size`` is one shingle. Null, empty and blank
    texts have no shingle and link with nothing. Repeated rows and exact copies
    share a component. Null ids are never the smallest. Empty tables give no
    rows; other columns are ignored; texts are whole, of any length.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stage(
        docs.withColumn("task", F.spark_partition_id()).mapInArrow(
            _node_rows(size), f"doc_id {kind}, n bigint, node bigint, profile binary, task int, block int, counts binary"
        ),
        "nodes",
    )
    nodes = made.where("block IS NULL").select("doc_id", "n", "node")
    homes = stage(
        made.where("block IS NULL AND n > 0").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("profile").alias("profile")),
        "homes",
    )

    rank = sc.broadcast(_rarity(made))
    # sizes up to where no set is light; all larger ones count as one size
    sizes = homes.groupBy(F.least("n", F.lit(500)).alias("size")).count().collect()
    boundary = choose_boundary([(r["size"], r["count"]) for r in sizes], percent)

    keyed = "key bigint, node bigint"
    shared = (
        docs.select("text").mapInArrow(_key_rows(size, percent, boundary, rank, None), keyed)
        .groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    )
    only = sc.broadcast(bitmap(shared, "key", BITMAP_BITS))
    keyed += ", n bigint, bits0 bigint, bits1 bigint, bits2 bigint, bits3 bigint"
    lists = stage(docs.select("text").mapInArrow(_key_rows(size, percent, boundary, rank, only), keyed).distinct(), "lists")

    # near copies share many keys: of lists with the same members one is enough
    marks = lists.groupBy("key").agg(F.expr("SUM(CAST(xxhash64(node) AS DECIMAL(28, 0))) AS mark"), F.count("*").alias("many"))
    kept = marks.where("many > 1").groupBy("mark", "many").agg(F.min("key").alias("key")).select("key")
    lists = stage(_with_partner(stage(lists.join(kept, "key", "left_semi"), "distinct_lists"), percent), "near_lists")

    profiles = homes.select("node", "n", "profile")
    homes = homes.select("node", "doc_id")
    links = tested = labels = None
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    for turn in range(PIVOT_ROUNDS + 1):
        current = lists
        if labels is not None:
            current = lists.join(labels, "node", "left").selectExpr("key", "node", "n", "COALESCE(label, node) AS label")
        else:
            current = lists.withColumn("label", F.col("node"))
        # the first round settles most lists with one pivot; few lists are left for those with more
        drawn = ", ".join(f"min_by(struct(node AS pivot, n AS m, label AS own), xxhash64(node, {turn}, {i}))" for i in range(PIVOTS if turn else 1))
        mixed = current.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.expr(f"array_distinct(array({drawn})) AS p")
        ).where("low < high")
        if turn < PIVOT_ROUNDS:
            pairs = (
                current.join(mixed.select("key", "p"), "key").selectExpr("node", "n", "label", "p.pivot AS pivots", "inline(p)")
                .where(f"label != own AND {fits} AND NOT (array_contains(pivots, node) AND node < pivot)").select("pivot", "node")
            )
        else:  # what the pivots have not settled: the remaining pairs of each list, block by block
            counted = current.groupBy("key").agg(F.expr(f"1 + COUNT(*) DIV {BLOCK_NODES} AS blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
            open_lists = current.join(counted.where("low < high").select("key", "blocks"), "key")
            sketches = open_lists.groupBy("node").agg(F.expr(f"slice(sort_array(collect_set(key)), 1, {SKETCH}) AS sketch"))
            open_lists = open_lists.join(sketches, "node").join(profiles.drop("n"), "node")
            pairs = (
                open_lists.selectExpr("*", "pmod(xxhash64(node), blocks) AS share", "explode(sequence(0L, blocks - 1)) AS other")
                .selectExpr("*", "least(share, other) AS low", "greatest(share, other) AS high")
                .groupBy("key", "low", "high")
                .applyInArrow(_pair_block(percent), "pivot bigint, node bigint")
            )
        pairs = pairs.distinct()
        if tested is not None:
            done = tested.unionByName(tested.selectExpr("node AS pivot", "pivot AS node"))
            pairs = pairs.join(done, ["pivot", "node"], "left_anti")
        if turn < PIVOT_ROUNDS:
            pairs = (
                pairs.join(profiles.selectExpr("node", "n AS na", "profile AS pa"), "node")
                .join(profiles.selectExpr("node AS pivot", "n AS nb", "profile AS pb"), "pivot")
                .mapInArrow(_likely_rows(percent), "pivot bigint, node bigint")
            )
        pairs = stage(pairs, "pairs")
        if not pairs.limit(1).count():
            if turn < PIVOT_ROUNDS:
                continue
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stage(_links(docs, pairs, homes, size, percent), "found")
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    if labels is None:
        return nodes.selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id") if not nodes.limit(1).count() else _named(nodes, None)
    return _named(nodes, labels)


def _named(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components as smallest document ids; documents without shingles stay alone."""
    full = nodes.where("n > 0")
    full = full.withColumn("label", F.col("node")) if labels is None else full.join(labels, "node", "left").selectExpr(
        "doc_id", "n", "COALESCE(label, node) AS label"
    )
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "label").selectExpr("doc_id", "n AS n_shingles", "component_id").unionByName(
        nodes.where("n = 0").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id")
    )


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (the one with the smallest id), with all columns.

    Documents without shingles are components of their own. Rows that repeat an
    id stay or go together, and so do all rows without an id.
    """
    kept = similar_documents(docs, size, percent).select("component_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.component_id"), "left_semi")
