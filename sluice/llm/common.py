"""Shared pieces: lineage cuts, hash folds, and vectorised word scanning of Arrow text batches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass holds; a longer single document is a pass of its own.
PASS_BYTES = 2 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and all runs on one machine (tests), one of our own."""
    sc = spark.sparkContext
    if d := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(d := tempfile.mkdtemp(prefix="sluice-"))
    return d


#: Spark's own setting by which a query's shuffle files go as the query ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end within leave no shuffle files."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    with cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Scratch:
    """Tables between the phases of one operator, in a folder of its own in the shared one; each goes when no phase needs it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        with cleaned(self.spark):
            df.select("*").write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        """These tables, or the whole folder."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}" if n else self.at)
            path.getFileSystem(conf).delete(path, True)


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")) % n


def mapped(df: DataFrame, cols: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of just these columns."""
    return df.select(*cols).mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, col: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes."""
    n = batch.num_rows
    if not n:
        return
    arr = batch.column(batch.schema.get_field_index(col))
    off = np.asarray(offsets(arr), dtype=np.int64)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(1, kind)
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array, nulls as empty texts."""
    if arr.null_count:
        arr = arr.fill_null("")
    off = offsets(arr).astype(np.int64)
    buf = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation: what lies between plain words.
PLAIN = _WS.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Bytes that are summed at once.
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    p[:1] = 1
    return np.cumprod(p, dtype=U64)


_LOW, _LOW_INV = _powers(_P, _BLOCK), _powers(_PINV, _BLOCK)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it lies; starts and ends are each in order.

    Differences of prefix sums of (byte + 1) P^i, divided by P^start. The sums are made block by block, so
    little more than the spans is held.
    """
    if not len(start):
        return np.zeros(0, U64)
    sums = (np.zeros(len(start), U64), np.zeros(len(start), U64))
    carry, high, step = 0, 1, pow(_P, _BLOCK, 1 << 64)
    x = np.empty(min(_BLOCK, len(data)) + 1, U64)
    x[0] = 0
    for lo in range(0, len(data), _BLOCK):
        n = min(_BLOCK, len(data) - lo)
        part = x[1 : n + 1]
        np.add(data[lo : lo + n], U64(1), out=part, casting="unsafe")
        part *= _LOW[:n]
        np.cumsum(part, out=part)
        for out, at in zip(sums, (start, end)):
            i, j = np.searchsorted(at, [lo, lo + n], side="right")
            if i < j:
                out[i:j] = x[at[i:j] - lo] * U64(high) + U64(carry)
        carry, high = (carry + int(part[-1]) * high) & _MASK, high * step & _MASK
    back = _powers(pow(_PINV, _BLOCK, 1 << 64), len(data) // _BLOCK + 1)
    h = sums[1] - sums[0]
    h *= _LOW_INV[start & (_BLOCK - 1)]
    h *= back[start >> 16]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of documents: byte spans and each document's first word."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(docs) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def words(arr: pa.Array, lower: bool = False, between: np.ndarray = _WS) -> Words:
    """Words of the texts, between bytes of the given class (white space)."""
    data, off = utf8(arr)
    if lower:
        data = _LOWER[data]
    isw = ~between[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, np.zeros(len(off), np.int64))
    before = np.empty(n, bool)
    before[0], before[1:] = False, isw[:-1]
    inner = off[1:-1]
    inner = inner[inner < n]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, isw[1:]
    after[inner[inner > 0] - 1] = False
    start = np.flatnonzero(isw & ~before)
    end = np.flatnonzero(isw & ~after) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, over a plain run of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * U64(0xC2B2AE3D27D4EB4F) + h[j : j + n]
        g ^= g >> U64(29)
    return mix(g)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words lie in one document."""
    ok = np.ones(int(first[-1]), bool)
    for j in range(1, k):
        e = first[1:] - j
        ok[e[e >= first[:-1]]] = False
    return np.flatnonzero(ok)


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast where a count has shown the frame to be small; else Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
