"""Mixture-controlled packing of token sequences.

Source queues are served by deficit round-robin. In each round (one window's
worth of tokens) a queue earns its share of the window and spends the whole
tokens it has earned; the fraction it could not spend is its deficit, carried
into the next round. A queue that runs dry leaves, and the others' shares are
scaled up from there on: a new phase. The served tokens form one line that is
cut every ``window`` tokens, so no window but the last has padding.

Because a queue's earnings after r rounds are ``floor(r * window * share)``, the
state of the robin before any round is known in closed form. Every task places
its own documents from that state and the tokens queued before them: deficits
carry across windows and tasks, and no task waits for another.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage, worker_cache

SHARE_BITS = 18  # shares are multiples of 2**-18, so that r * window * share fits a long
_CACHE_WORDS = 1 << 20
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# ---- tokens ----------------------------------------------------------------
def _letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: itself if printable, else the next character from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _encoder(path: str):
    """Tokenizer and word cache of this Python worker; they outlive a task."""
    held = worker_cache("packing")
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        probe = ["the", "von", "\u00fcber", "\u00e9t\u00e9", "anderswo"]
        whole = [e.ids for e in tokenizer.encode_batch(probe, add_special_tokens=False)]
        letters = _letters()
        by_model = [[t.id for t in tokenizer.model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in probe]
        held[path] = (tokenizer, {"": b""}, letters, whole == by_model)
    return held[path]


def encode(texts: list[str], path: str, end: int) -> list[bytes]:
    """Ids of each text as little-endian 32-bit values, ``end`` last.

    For vocabularies whose tokens never reach across white space, nor from
    letters into punctuation: each distinct word is encoded once and looked up
    after that. A word of Latin-1 letters, with or without punctuation behind
    it, goes straight to the vocabulary's merges (its normal form is its lower
    case); all others take the tokenizer's full path. The white space that parts
    words here is a subset of what the tokenizer drops, so the ids are those of
    the whole text.
    """
    tokenizer, known, letters, direct = _encoder(path)
    if len(known) > _CACHE_WORDS:
        known.clear()
        known[""] = b""
    words = [t.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") for t in texts]
    seen: set[str] = set()
    for ws in words:
        seen.update(ws)
    full, parts = set(), {}
    tokenize = tokenizer.model.tokenize
    for w in seen.difference(known):
        stem = w.rstrip(_PUNCTUATION)
        tail = w[len(stem) :]
        if not direct or not stem.isalpha() or max(stem) > "\u00ff" or "<|" in w:  # special tokens start so
            full.add(w)
            continue
        core = stem.lower()
        if core not in known:
            raw = core if core.isascii() else core.encode().decode("latin-1").translate(letters)
            known[core] = _ids([t.id for t in tokenize(raw)])
        if not tail:
            known[w] = known[core]
        elif tail in known:
            known[w] = known[core] + known[tail]
        else:
            full.add(tail)
            parts[w] = (core, tail)
    full = list(full)
    for w, e in zip(full, tokenizer.encode_batch_fast(full, add_special_tokens=False)):
        known[w] = _ids(e.ids)
    for w, (core, tail) in parts.items():
        known[w] = known[core] + known[tail]
    last = _ids([end])
    return [b"".join(map(known.__getitem__, ws)) + last for ws in words]


def _tokens(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queued: dict[int, int] = {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            queues, ids = batch.column("queue").to_pylist(), batch.column("doc_id")
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 2 << 20):
                    size += len(texts[to])
                    to += 1
                found = encode(texts[at:to], path, end)
                start = []
                for q, x in zip(queues[at:to], found):
                    start.append(queued.get(q, 0))
                    queued[q] = start[-1] + len(x) // 4
                # 16 bits hold ids of vocabularies up to 65,536; larger ones keep 32
                narrow = [np.frombuffer(x, "<u4") for x in found]
                width = 2 if all(x.max(initial=0) < 1 << 16 for x in narrow) else 4
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, to - at),
                        batch.column("queue").slice(at, to - at),
                        batch.column("part").slice(at, to - at),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) for x in narrow], pa.int64()),
                        pa.array([width] * len(found), pa.int32()),
                        pa.array([x.astype(f"<u{width}").tobytes() for x in narrow], pa.binary()),
                    ],
                    names=["doc_id", "queue", "part", "start", "n", "width", "tokens"],
                )
                at = to

    return run


# ---- the robin -------------------------------------------------------------
def shares(weights: list[float]) -> list[int]:
    """Weights as whole multiples of 2**-18 that add up to one, each at least one unit."""
    whole = 1 << SHARE_BITS
    if len(weights) > whole // 2:
        raise ValueError(f"{len(weights)} queues: shares have {SHARE_BITS} bits")
    total = float(sum(weights))
    out = [max(1, int(w / total * whole)) for w in weights]
    out[out.index(max(out))] += whole - sum(out)
    return out


def phases(tokens: list[int], weights: list[float], window: int) -> list[dict]:
    """Phases of the robin: (base, active queues, shares, tokens left, tokens used before)."""
    left, used, base, out = list(tokens), [0] * len(tokens), 0, []
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        share = shares([weights[i] for i in active])
        rounds = min(-(-(left[i] << SHARE_BITS) // (window * s)) for i, s in zip(active, share))
        served = [min(left[i], rounds * window * s >> SHARE_BITS) for i, s in zip(active, share)]
        out.append({"base": base, "active": active, "share": share, "left": [left[i] for i in active], "used": list(used)})
        for i, n in zip(active, served):
            left[i] -= n
            used[i] += n
        base += sum(served)
    return out


def place(queue: int, begin: np.ndarray, n: np.ndarray, plan: list[dict], window: int):
    """Cut documents of one queue into served pieces.

    ``begin`` holds each document's first token within its queue. Returns
    (document, first token within it, length, position on the line) per piece.
    """
    doc, first, length, line = [], [], [], []
    bounds = [p["used"][queue] for p in plan] + [np.iinfo(np.int64).max]
    from_, to = (int(begin.min()), int((begin + n).max())) if len(begin) else (0, 0)
    for k, p in enumerate(plan):
        if bounds[k + 1] <= from_ or bounds[k] >= to or queue not in p["active"]:
            continue
        lo = np.maximum(begin, bounds[k])
        hi = np.minimum(begin + n, bounds[k + 1])
        docs = np.flatnonzero(lo < hi)
        if not len(docs):
            continue
        here = p["active"].index(queue)
        share, left = np.array(p["share"], np.int64), np.array(p["left"], np.int64)
        a, b = lo[docs] - bounds[k], hi[docs] - bounds[k]
        step = window * int(share[here])
        turn = lambda j: -(-((j + 1) << SHARE_BITS) // step) - 1  # noqa: E731  the round that serves token j
        low, high = turn(a), turn(b - 1)
        count = high - low + 1
        owner = np.repeat(np.arange(len(docs)), count)
        r = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        uniq, back = np.unique(r, return_inverse=True)
        round_at, rows = np.empty(len(uniq), np.int64), max(1, (1 << 20) // len(share))
        for i in range(0, len(uniq), rows):  # bounds the working arrays
            some = uniq[i : i + rows, None] * window
            before = np.minimum((some * share) >> SHARE_BITS, left)
            after = np.minimum(((some + window) * share[:here]) >> SHARE_BITS, left[:here])
            round_at[i : i + rows] = p["base"] + before.sum(1) + (after - before[:, :here]).sum(1)
        own = np.minimum((uniq * step) >> SHARE_BITS, left[here])
        own_end = np.minimum(((uniq + 1) * step) >> SHARE_BITS, left[here])
        s, e = np.maximum(own[back], a[owner]), np.minimum(own_end[back], b[owner])
        at = round_at[back] + s - own[back]
        keep = e > s
        doc.append(docs[owner[keep]])
        first.append((s + bounds[k])[keep] - begin[docs[owner[keep]]])
        length.append((e - s)[keep])
        line.append(at[keep])
    if not doc:
        return (np.zeros(0, np.int64),) * 4
    doc, first, length, line = map(np.concatenate, (doc, first, length, line))
    # a piece that reaches over the end of a window is cut there (it is no longer than a window)
    room = window - line % window
    over = np.flatnonzero(length > room)
    tail = doc[over], first[over] + room[over], length[over] - room[over], line[over] + room[over]
    length = np.minimum(length, room)
    out = [np.concatenate(x) for x in zip((doc, first, length, line), tail)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def _pieces(plan: list[dict], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queues = batch.column("queue").to_numpy()
            begin = batch.column("start").to_numpy() + batch.column("before").to_numpy()
            n, width, tokens = batch.column("n").to_numpy(), batch.column("width").to_numpy(), batch.column("tokens")
            for q in np.unique(queues):
                rows = np.flatnonzero(queues == q)
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    doc, first, length, line = place(int(q), begin[some], n[some], plan, window)
                    ids = [np.frombuffer(tokens[int(i)].as_buffer(), f"<u{width[i]}").astype("<u4") for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(some[doc])),
                            pa.array(first),
                            pa.array(length),
                            pa.array(n[some][doc]),
                            pa.array(line // window),
                            pa.array(line % window),
                            pa.array(np.full(len(doc), q, np.int32)),
                            pa.array([ids[d][f : f + m].tobytes() for d, f, m in zip(doc, first, length)], pa.binary()),
                        ],
                        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", "ids"],
                    )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    targets: Mapping[str, float] | None = None,
    end: int = 2,
) -> DataFrame:
    """Pack every document into windows of ``window`` tokens at target token shares.

    ``docs`` needs doc_id, text and source. ``targets`` gives a weight per source
    (sources it does not name share one queue of weight 1); without it each
    source's weight is its token count, so all queues last to the end, and every
    source has a queue of its own. ``tokenizer`` is the path of a vocabulary file
    on every machine.

    Returns one row per piece: doc_id, start and length within the document's
    ids, doc_tokens, sequence_id, offset, queue, ids (little-endian 32 bits).

    Null or empty text is the end id alone; a null source is a queue like any
    other; repeated rows and null ids are packed row by row; no rows give no
    rows; other columns are ignored. A text of any length is one row of ids.
    """
    spark = docs.sparkSession
    names = sorted(targets) if targets else [
        r[0] for r in docs.groupBy("source").count().orderBy(F.desc("count"), "source").collect()
    ]
    # one row per source, as many as the plan of phases has queues anyway
    known = spark.createDataFrame(
        pa.table({"_name": pa.array(names, pa.string()), "_queue": pa.array(range(len(names)), pa.int32())}), "_name string, _queue int"
    )
    queued = docs.select("doc_id", "text", "source").join(F.broadcast(known), F.expr("source <=> _name"), "left").select(
        "doc_id", "text", F.expr(f"COALESCE(_queue, {len(names)})").alias("queue"), F.spark_partition_id().alias("part")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stage(
        queued.mapInArrow(
            _tokens(tokenizer, end),
            f"doc_id {kind}, queue int, part int, start bigint, n bigint, width int, tokens binary",
        ),
        "tokens",
    )
    # Tokens queued before each task's own: one row per task and queue, kept as a
    # table so that its true size decides whether the join sends it around.
    counts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = stage(
        counts.selectExpr(
            "queue", "part",
            "COALESCE(SUM(n) OVER (PARTITION BY queue ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
            "n AS part_tokens",
        ),
        "queued",
    )
    sums = {r["queue"]: r["n"] for r in before.groupBy("queue").agg(F.sum("part_tokens").alias("n")).collect()}
    held = [sums.get(i, 0) for i in range(len(names) + 1)]
    weights = [float(targets[n]) for n in names] + [1.0] if targets else [float(max(1, n)) for n in held]
    return tokens.join(before.drop("part_tokens"), ["queue", "part"]).mapInArrow(
        _pieces(phases(held, weights, window), window),
        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue int, ids binary",
    )
