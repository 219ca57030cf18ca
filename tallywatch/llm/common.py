"""Helpers shared by the text operators: staged tables, bounded bitmaps, word hashes."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.session import scratch_path

_MASK = (1 << 64) - 1
_CHUNK = 1 << 20  # bytes of text hashed at a time; bounds the working arrays, not the texts


def stage(df: DataFrame, name: str, partition_rows: int | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables of one operator, to be removed when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Give the disk back. Frames that read these tables can't be run again after this."""
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            files.delete(folder.getParent(), True)  # the parent has a name of its own per table
        self.paths.clear()


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python process, for what is dear to build again per task."""
    holder = sys.modules.setdefault("tallywatch_worker_cache", types.ModuleType("tallywatch_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def drop_caches(kept: str) -> None:
    """Give back what other operators left in this Python process, which serves one after another."""
    holder = sys.modules.get("tallywatch_worker_cache")
    for name, held in list(vars(holder).items()) if holder else []:
        if isinstance(held, dict) and name != kept:
            held.clear()


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of 64-bit hashes as a bitmap of 2**bits bits, whatever the number of hashes.

    The bitmap's size is fixed, so it may be broadcast at every scale. It only
    thins rows out: hashes that share a bit pass too, and a later join on the
    hash itself decides.
    """
    words = (
        df.selectExpr(f"shiftrightunsigned({column} & {(1 << bits) - 1}L, 6) AS word", f"shiftleft(1L, CAST({column} & 63 AS INT)) AS bit")
        .groupBy("word")
        .agg(F.expr("bit_or(bit) AS bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return out


def in_bitmap(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(table) * 64 - 1)
    at = hashes & bits
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def in_bitmap_rows(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """Rows whose hash is in the bitmap, without leaving the JVM. The bitmap is one value of fixed size."""
    row = df.sparkSession.createDataFrame(
        pa.table({"_bits": pa.array([table.view(np.int64)], pa.list_(pa.int64()))}), "_bits array<bigint>"
    )
    word = F.expr(f"CAST(shiftrightunsigned({column} & {len(table) * 64 - 1}L, 6) AS INT)")
    bit = F.expr(f"CAST({column} & 63 AS INT)")
    # as a scalar subquery: a joined column would be copied with every row
    return df.where(F.call_function("getbit", F.get(row.scalar(), word), bit) == 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_cache("powers")
    if len(held.get("up", ())) < n:
        size = max(n, _CHUNK + 4096)
        held.update(up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return held["up"], held["down"]


def byte_table(separators: str) -> np.ndarray:
    """256 booleans: True for bytes of words, given the ASCII bytes that part them."""
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


SPACE = byte_table(" \t\n\v\f\r")
ALPHANUMERIC = byte_table("".join(chr(i) for i in range(128) if not chr(i).isalnum() or chr(i).isupper()))


def _hash_chunk(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64)), starts


def hash_words(texts: list[bytes], table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of texts that are in lower case, about a megabyte of text at a time.

    Yields (first text, one past the last, hashes, offsets): the words of text
    ``first + i`` are ``hashes[offsets[i]:offsets[i + 1]]``. A text of any length
    comes whole; within it the byte arrays are cut between words.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _CHUNK):
            size += len(texts[last]) + 1
            last += 1
        joined = b"\n".join(texts[first:last])
        data = np.frombuffer(joined, np.uint8)
        begin = np.zeros(last - first + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[first:last]], out=begin[1:])
        hashes, starts, at = [], [], 0
        while at < len(data):
            to = min(len(data), at + _CHUNK + 2048)
            while to < len(data) and table[data[to - 1]]:  # end behind a separator
                to += 1
            h, s = _hash_chunk(data[at:to], table)
            hashes.append(h)
            starts.append(s + at)
            at = to
        found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        yield first, last, found, np.searchsorted(where, begin)
        first = last


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; position i covers words i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : n + k]
    return mix(out + np.uint64(size))


def lowered(column) -> list[bytes]:
    """An Arrow text column as bytes with A-Z in lower case; null is empty."""
    return [b"" if x is None else x.encode().lower() for x in column.to_pylist()]


def text_parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about a megabyte of text each, one text at least: only so much becomes Python objects at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            held = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, held + _CHUNK, side="right")))
            yield batch.slice(first, last - first)
            first = last


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


_BLANK = re.compile(rb"[\x09-\x0D\x20]")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words between ASCII blanks, about a megabyte of text at a time; words are never cut."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + _CHUNK) if len(text) - at > _CHUNK else None
        stop = end.end() if end else len(text)
        yield text[at:stop].split()
        at = stop
