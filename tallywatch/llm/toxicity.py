"""Toxic passages as maximum-scoring segments.

Fitting takes a bounded sample of labelled rows. Tokens are whole words and the
characters of words: runs of five, and beginnings of three to seven, so that
inflected and compound forms share evidence in any language. Every token gets
its shrunken log-odds between toxic and clean documents: a mixture of tokens
without and with a class of their own, whose rate is learned from the sample,
so that small samples shrink more and none switches off. A word scores as its
most telling token. A linear-time scan then finds every maximal segment of a
document, and extreme-value statistics of the clean documents tell which are
too good for chance: a segment of score S among n words has E = K n exp(-S)
expected equals. The best segment's -ln E and the number of significant
segments become a probability by a logistic fit on the same sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import _BASE, _INVERSE, ALPHANUMERIC, drop_caches, hash_words, lowered, mix, shingles, signed, stage, text_parts

FIT_ROWS = 20_000  # labelled rows that the fit aims at
PRIOR_DOCS = 2.0  # weight of the class shares in a telling token's prior, in documents
GRAM = 5  # characters of a run within a word
STARTS = range(3, 8)  # characters of a word's beginning
SIGNIFICANT = 0.05  # a passage is reported up to this E
BLOCK = 1 << 16  # prefixes of hashes that are looked up at a time


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of all tokens of the sample
    scores: np.ndarray
    drift: float  # taken from every word's score: exp(score) has mean 1 over words of clean documents
    log_k: float
    weights: np.ndarray  # logistic: constant, -ln E, log of one plus significant passages
    table: Broadcast | None = field(default=None, repr=False)  # tokens and scores, sent once however often the numbers change

    def parts(self) -> tuple:
        """What goes to the workers: arrays and numbers only, since they do not have this class."""
        return self.tokens, self.scores, self.drift, self.log_k, self.weights

    def shared(self, sc: SparkContext) -> tuple[Broadcast, tuple]:
        """The same, the arrays broadcast."""
        if self.table is None:
            self.table = sc.broadcast(self.parts()[:2])
        return self.table, self.parts()[2:]


# ---- segments --------------------------------------------------------------
def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past the last, score) in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, end, sum before, sum after, nearest earlier one with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, sums[i], sums[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, i + 1, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in found]


# ---- tokens ----------------------------------------------------------------
def word_tokens(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of each distinct word, about a megabyte of text at a time.

    Yields (first text, one past the last, word numbers, offsets, tokens, token
    offsets): the words of text ``first + i`` are ``numbers[offsets[i]:offsets[i + 1]]``,
    and the tokens of word k are ``tokens[at[k]:at[k + 1]]``, the word's own first.
    """
    for first, last, hashes, offsets in hash_words(texts, ALPHANUMERIC):
        data = np.frombuffer(b"\n".join(texts[first:last]), np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ALPHANUMERIC[data]
        edges = np.flatnonzero(np.diff(inside))
        words, index, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = edges[0::2][index], edges[1::2][index]
        found, sizes = [], []
        for k in range(0, len(words), 1 << 16):
            t, n = _grams(data, starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], words[k : k + (1 << 16)])
            found.append(t)
            sizes.append(n)
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        yield first, last, numbers, offsets, np.concatenate(found) if found else words, at


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the given words, word by word, and their number for each word."""
    size = ends - starts
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(size)), size)
    text = data[np.arange(size.sum()) + (starts - begin)[own]]
    lead = np.flatnonzero((text & 0xC0) != 0x80)  # first bytes of characters
    of = own[lead]
    chars = np.bincount(of, minlength=len(size))
    nth = np.arange(len(lead)) - (np.cumsum(chars) - chars)[of]
    bound = np.append(lead, len(text))
    up, down = (np.full(len(text) + 1, b, np.uint64) for b in (_BASE, _INVERSE))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    word, token = [np.arange(len(words))], [words]
    for n, start in [(GRAM, False)] + [(n, True) for n in STARTS]:
        k = np.flatnonzero((nth + n <= chars[of]) & ((nth == 0) | (not start)))
        a, b = bound[k], bound[k + n]
        word.append(of[k])
        token.append(mix((sums[b] - sums[a]) * down[a] + np.uint64((2 * n + start) * _INVERSE & (1 << 64) - 1)))
    word, token = np.concatenate(word), np.concatenate(token)
    return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class _Scores:
    """Scores of tokens by their hash; tokens that the sample does not have score 0."""

    def __init__(self, model: Model):
        self.tokens, self.scores = model.tokens, model.scores  # the broadcast arrays themselves, no copies
        bits = max(1, len(model.tokens)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.starts = np.empty(1 << bits, np.int64 if bits > 31 else np.int32)
        for k in range(0, 1 << bits, BLOCK):  # in blocks: the prefixes and their places at once are many times the table
            prefixes = np.arange(k, min(k + BLOCK, 1 << bits), dtype=np.uint64)
            self.starts[k : k + BLOCK] = np.searchsorted(model.tokens, prefixes << self.shift)
        self.drift = model.drift

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(tokens)), np.arange(len(tokens) if len(self.tokens) else 0)
        at = np.minimum(self.starts[(tokens >> self.shift).astype(np.int64)], len(self.tokens) - 1).astype(np.int64)[: len(rows)]
        while len(rows):
            here = self.tokens[at]
            hit = here == tokens[rows]
            out[rows[hit]] = self.scores[at[hit]]
            on = (here < tokens[rows]) & (at < len(self.tokens) - 1)
            rows, at = rows[on], at[on] + 1
        return out

    def words(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A word's score: that of its token farthest from 0, less the drift."""
        if len(at) < 2:
            return np.zeros(0)
        own = self.of(tokens)
        high, low = np.maximum.reduceat(own, at[:-1]), np.minimum.reduceat(own, at[:-1])
        return np.where(high >= -low, high, low) - self.drift


def _score_rows(shared: Broadcast, numbers_of: tuple, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(kept="powers")
        model = Model(*shared.value, *numbers_of)
        table = _Scores(model)
        for batch in text_parts(batches, text):
            for first, last, numbers, offsets, tokens, at in word_tokens(lowered(batch.column(text))):
                scores = table.words(tokens, at)[numbers]
                top, best, significant, passages = [], [], [], []
                for i in range(last - first):
                    own = scores[offsets[i] : offsets[i + 1]]
                    found = segments(own) if len(own) and own.max() > 0 else []
                    size = math.log(max(1, len(own))) + model.log_k
                    rated = [(a, b - a, s, math.exp(min(50.0, size - s))) for a, b, s in found]
                    good = [x for x in rated if x[3] <= SIGNIFICANT]
                    top.append(max((x[2] for x in rated), default=0.0))
                    best.append(top[-1] - size)
                    significant.append(len(good))
                    passages.append([dict(zip(("first_word", "n_words", "score", "expected"), x)) for x in good])
                logit = _traits(np.array(top), np.array(best), np.array(significant)) @ model.weights
                rest = [batch.column(c).slice(first, last - first) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    rest
                    + [
                        pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500)))),
                        pa.array(top, pa.float64()),
                        pa.array(best, pa.float64()),
                        pa.array(significant, pa.int64()),
                        pa.array(passages, pa.list_(_PASSAGE)),
                    ],
                    names=[c for c in batch.schema.names if c != "text"] + ["score", "top", "best", "significant", "passages"],
                )

    return run


def _traits(top: np.ndarray, best: np.ndarray, significant: np.ndarray) -> np.ndarray:
    """What the probability is made of. A best segment no better than chance, or none, counts as nothing, however short the text."""
    return np.column_stack([np.ones(len(best)), np.where(top > 0, np.maximum(best, 0.0), 0.0), np.log1p(significant)])


_PASSAGE = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
_SCORED = "score double, top double, best double, significant bigint, passages array<struct<first_word bigint, n_words bigint, score double, expected double>>"


def _scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The frame's columns, except one named text, with the model's columns; ``text`` names the column that is scored."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_score_rows(*model.shared(docs.sparkSession.sparkContext), text), f"{kept}, {_SCORED}")


# ---- fitting ---------------------------------------------------------------
def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_parts(batches, "text"):
        toxic = batch.column("toxic").to_numpy().astype(bool)
        for first, last, numbers, offsets, tokens, at in word_tokens(lowered(batch.column("text"))):
            # a token counts once per document: repeats within one are no new evidence
            own = []
            for i in range(last - first):
                words = np.unique(numbers[offsets[i] : offsets[i + 1]])
                n = at[words + 1] - at[words]
                own.append(np.unique(tokens[np.arange(n.sum()) + np.repeat(at[words] - np.cumsum(n) + n, n)]))
            mark = np.repeat(toxic[first:last], [len(x) for x in own])
            words, back = np.unique(np.concatenate(own), return_inverse=True)
            bad = np.bincount(back[mark], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(words)), pa.array(bad), pa.array(np.bincount(back, minlength=len(words)) - bad)],
                names=["word", "in_toxic", "in_clean"],
            )


def _drift_rows(shared: Broadcast, numbers_of: tuple):
    """Words of clean documents, and the sum of exp(score) over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Scores(Model(*shared.value, *numbers_of))
        for batch in text_parts(batches, "text"):
            clean = batch.column("toxic").to_numpy() == 0
            n, total = 0, 0.0
            for first, last, numbers, offsets, tokens, at in word_tokens(lowered(batch.column("text"))):
                own = numbers[np.repeat(clean[first:last], np.diff(offsets))]
                n, total = n + len(own), total + float(np.exp(table.words(tokens, at)[own]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    return run


def _log_odds(t: np.ndarray, c: np.ndarray, share: float) -> np.ndarray:
    """Shrunken log-odds of tokens held by t toxic and c clean documents.

    A token either follows the toxic ``share`` of the sample, or has a share of
    its own with a beta prior around it. The rate of the second kind is found by
    expectation maximisation over all tokens; a token's log-odds are weighted by
    the probability that it is of the second kind.
    """
    pairs, back, n = np.unique(np.column_stack([t, c]), axis=0, return_inverse=True, return_counts=True)
    a, b = PRIOR_DOCS * share, PRIOR_DOCS * (1 - share)
    fixed = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    gain = np.array([
        fixed + math.lgamma(x + a) + math.lgamma(y + b) - math.lgamma(x + y + a + b) - x * math.log(share) - y * math.log(1 - share)
        for x, y in pairs.tolist()
    ])
    rate = 0.01
    for _ in range(50):
        telling = 1 / (1 + np.exp(-np.clip(gain + math.log(rate / (1 - rate)), -500, 500)))
        rate = (float(telling @ n) + 1) / (n.sum() + 100)
    odds = np.log((pairs[:, 0] + a) / (pairs[:, 1] + b)) - math.log(a / b)
    return (telling * odds)[back.reshape(-1)]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's five-word runs, which near copies mostly share."""
    drop_caches(kept="powers")
    for batch in text_parts(batches, "text"):
        least = []
        for first, last, hashes, offsets in hash_words(lowered(batch.column("text")), ALPHANUMERIC):
            for i in range(last - first):
                words = hashes[offsets[i] : offsets[i + 1]]
                least.append(int(signed(shingles(words, min(5, len(words))).min(keepdims=True))[0]) if len(words) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "sketch"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from about ``fit_rows`` labelled documents, picked by a hash of their id.

    Only rows whose ``crc32(doc_id as text) mod 5`` is not 0 are learned from.
    Of near copies in the sample one is kept, so that a much copied text does
    not pass for a trait of its class. Null labels are left out; with no labels
    at all every score is 0.5 or less.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 != 0")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = usable.count()
    part = min(1 << 20, math.ceil((1 << 20) * fit_rows / max(1, total)))
    sample = usable.where(f"pmod(xxhash64(doc_id), {1 << 20}) < {part}")
    # about fit_rows rows of two numbers: bounded, so the documents stay where they are
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    train = stage(texts.mapInArrow(_sketch_rows, f"doc_id {kind}, text string, toxic int, sketch bigint"), "train")
    train = stage(
        train.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY sketch, toxic ORDER BY doc_id, text) AS copy")
        .where("copy = 1").select("text", "toxic"),
        "train_texts",
    )
    counts = (
        train.mapInArrow(_count_rows, "word bigint, in_toxic bigint, in_clean bigint")
        .groupBy("word")
        .agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    )
    counts = stage(counts, "word_counts")
    docs_of = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = docs_of.get(1, 0), docs_of.get(0, 0)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), 1e-3, 0.0, np.zeros(3))
    if n_t and n_c:
        # all tokens of the sample, three numbers each
        held = counts.toArrow()
        tokens = held.column("word").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        model.tokens, model.drift = tokens[order], 0.0
        model.scores = _log_odds(held.column("t").to_numpy(), held.column("c").to_numpy(), n_t / (n_t + n_c))[order]
        words = train.mapInArrow(_drift_rows(*model.shared(docs.sparkSession.sparkContext)), "n bigint, total double").selectExpr("SUM(n) AS n", "SUM(total) AS total").first()
        model.drift = max(1e-3, math.log(words["total"] / words["n"])) if words["n"] else 1e-3
    rated = _scored(train, model).select("toxic", "best").toArrow()  # about fit_rows rows
    y, best = rated.column("toxic").to_numpy().astype(float), rated.column("best").to_numpy()
    if len(y):
        clean = best[(y == 0)]
        # clean documents' best segments follow a Gumbel law around ln K + Euler's constant
        model.log_k = float(np.mean(clean) - 0.5772) if len(clean) > 20 else 0.0
        again = _scored(train, model).select("toxic", "top", "best", "significant").toArrow()
        y = again.column("toxic").to_numpy().astype(float)
        model.weights = _logistic(_traits(again.column("top").to_numpy(), again.column("best").to_numpy(), again.column("significant").to_numpy()), y)
    else:
        model.weights = np.array([-1.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages, one row per document row.

    A passage is (first word, words, score, expected number of equals by chance).
    Null and empty texts have no segment and get the score of such texts; null
    ids are scored and not held out; repeated rows are scored alike; an empty
    table gives no rows. Whole texts are scanned, of any length.
    """
    model = fit(docs, labels, fit_rows)
    return _scored(docs.select("doc_id", "text"), model).selectExpr(
        "doc_id", "COALESCE(crc32(CAST(doc_id AS STRING)) % 5 = 0, false) AS held_out", "score",
        "CAST(score >= 0.5 AS INT) AS predicted", "passages",
    )


def clean_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(docs, labels, fit_rows)
    # columns travel under numbers, so that none has the name of a score; the text travels once
    frame = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    return _scored(frame, model, f"_{docs.columns.index('text')}").where("score < 0.5").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
