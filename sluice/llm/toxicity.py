"""A toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training documents are dealt over a few shards of about ten thousand. Each shard runs FTRL-proximal with its own
per-coordinate rates and L1, and the shards' weights are averaged; L1 leaves few of them, so what is
broadcast is at most one weight a hash bucket and in practice a few thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import PLAIN, U64, Words, cut, fold, gram_starts, mapped, maybe_broadcast, mix, pieces, record, words
from sluice.llm.labelled import labels_sample

BITS = 20
#: Labelled documents to learn from, at most (by a hash of their ids), and how many a shard has, about; a shard sees its documents a few times, a small one more often.
LEARN_DOCS, SHARD_DOCS = 30_000, 10_000
_SALTS = (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD)


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash bucket) of every word, word pair, and pair with one word skipped; repeats included."""
    h, doc, keep = w.hashes(), w.doc(), U64((1 << bits) - 1)
    ids, docs = [mix(h + U64(_SALTS[0])) & keep], [doc]
    for gap, salt in ((1, _SALTS[1]), (2, _SALTS[2])):
        at = gram_starts(w.first, gap + 1)
        ids.append(mix(h[at] * U64(salt) + h[at + gap]) & keep)
        docs.append(doc[at])
    return np.concatenate(docs), np.concatenate(ids).astype(np.int32)


def unique_features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(first, ids): each document's distinct buckets, in order."""
    doc, ids = features(w, bits)
    key = np.unique(doc.astype(np.int64) << bits | ids)
    return np.searchsorted(key >> bits, np.arange(len(w.first))), (key & ((1 << bits) - 1)).astype(np.int32)


def ftrl(docs: list[np.ndarray], y: np.ndarray, epochs: int = 3, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.02) -> np.ndarray:
    """Weights of the buckets and, last, of the bias; each document's features are its distinct buckets, at 1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    at_l1 = np.full(len(z), l1)
    at_l1[-1] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= at_l1[i], 0.0, -(zi - np.sign(zi) * at_l1[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    full = [np.append(d, len(z) - 1) for d in docs]
    for _ in range(epochs):
        for i, t in zip(full, y):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - t
            was = n[i]
            n[i] = was + g * g
            z[i] += g - (np.sqrt(n[i]) - np.sqrt(was)) / alpha * w
    return weights(np.arange(len(z)))


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray | None:
    """Averaged weights from the documents that ``sample`` (doc_id, y) labels; None if there are none."""
    out = pa.schema([("shard", pa.int32()), ("order", pa.int64()), ("y", pa.float64()), ("ids", pa.binary())])
    n = sample.count()
    shards = max(1, min(n, LEARN_DOCS) // SHARD_DOCS)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(maybe_broadcast(sample, n, 4 * LEARN_DOCS), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")  # however often an id repeats
    order = F.xxhash64(F.lit("order"), F.col("doc_id"))
    rows = rows.select("text", "y", order.alias("order"), F.pmod(order, F.lit(shards)).cast("int").alias("shard"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                first, ids = unique_features(words(p.column(0), True, PLAIN))
                yield record(out, p.column(3), p.column(2), p.column(1), [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])])

    learnt = pa.schema([("i", pa.int32()), ("w", pa.float64())])

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by("order")
        w = ftrl([np.frombuffer(b, np.int32) for b in t["ids"].to_pylist()], t["y"].to_numpy(), max(3, min(20, 10_000 // t.num_rows)), l1=min(3.0, max(0.7, t.num_rows / 1800)))  # fewer documents repeat a word less often
        i = np.flatnonzero(w)
        return pa.table([pa.array(i, pa.int32()), pa.array(w[i])], schema=learnt)

    got = rows.mapInArrow(found, "shard int, order bigint, y double, ids binary")
    w = got.groupBy("shard").applyInArrow(train, "i int, w double").groupBy("i").agg((F.sum("w") / shards).alias("w")).toPandas()  # a row a bucket at most
    if not len(w):
        return None
    dense = np.zeros((1 << BITS) + 1)
    dense[w["i"]] = w["w"]
    return dense


def score_toxicity(docs: DataFrame, labels: DataFrame, held: Column, learn_docs: int = LEARN_DOCS) -> DataFrame:
    """(doc_id, score) of each document: the chance that its toxic label is 1.

    Learns from labels whose doc_id is not ``held``. Words are runs of letters and digits, lower-cased A-Z.
    Needs doc_id and text of documents, doc_id and toxic of labels; other columns are ignored. Null and empty
    texts get the score of the bias alone; null and repeated ids are scored row by row, and a labelled one that
    repeats is learnt from once, by its text with the least hash. A very long text is held whole by one task.
    With no label to learn from, every score is 0; an empty table gives no rows.
    """
    w = fit(docs, labels_sample(labels, "toxic", ~F.coalesce(held, F.lit(False)), learn_docs))
    if w is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    at = np.flatnonzero(w)
    weight, top = w[at].astype(np.float64), len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(top)
        table[at] = weight
        for b in batches:
            for p in pieces(b, "text"):
                doc, ids = features(words(p.column(1), True, PLAIN))
                on = np.flatnonzero(table[ids])  # few: only buckets that L1 has left
                key = np.unique(doc[on].astype(np.int64) << BITS | ids[on])
                s = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], p.num_rows) + table[-1]
                yield record(out, p.column(0), 1 / (1 + np.exp(-np.clip(s, -35, 35))))

    return mapped(docs, ["doc_id", "text"], run, "doc_id bigint, score double")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that toxicity is never learnt from: crc32 of the id as text mod 5 is 0."""
    return fold(doc_id, 5) == 0
