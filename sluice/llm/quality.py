"""A quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, fold, mapped, maybe_broadcast, pieces, record
from sluice.llm.labelled import labels_sample
from sluice.llm.stats import FEATURES, document_stats, measure, ratio_matrix, ratios

#: Labelled rows to learn from, at most (by a hash of their ids); sums of normal equations come from as many tasks.
LEARN_ROWS, LEARN_TASKS = 100_000, 8
FOLDS, BINS = 4, 1000


@dataclass(frozen=True)
class Fourier:
    """x -> sqrt(2/D) cos(Wx + b) and 1: its products approximate the Gaussian kernel of the given width on standardised x."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def draw(mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int) -> Fourier:
        rng = np.random.default_rng(seed)
        return Fourier(mean, scale, rng.normal(0, 1 / width, (len(mean), size)), rng.uniform(0, 2 * np.pi, size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES]).astype(float).reshape(-1, len(FEATURES))


def normal_equations(rows: DataFrame, phi: Fourier) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Z'Z and Z'y of each fold, summed in each partition and then over partitions."""
    size = len(phi.b) + 1
    out = pa.schema([("f", pa.int32()), ("s", pa.binary())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            z, y, f = phi(_matrix(b)), b.column(b.schema.get_field_index("y")).to_numpy(), b.column(b.schema.get_field_index("f")).to_numpy()
            for k in np.unique(f):
                zk = z[f == k]
                total[k] = total.get(k, 0) + np.column_stack([zk.T @ zk, zk.T @ y[f == k]])
        if total:
            yield record(out, list(total), [t.tobytes() for t in total.values()])

    got: dict[int, np.ndarray] = {}
    for r in rows.select("y", "f", *FEATURES).mapInArrow(sums, "f int, s binary").collect():  # a row of fixed size for each of LEARN_TASKS tasks and FOLDS folds
        got[r.f] = got.get(r.f, 0) + np.frombuffer(r.s).reshape(size, size + 1)
    return {k: (t[:, :-1], t[:, -1]) for k, t in got.items()}


def ridge(parts: list[tuple[np.ndarray, np.ndarray]], lam: float) -> np.ndarray:
    a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
    return np.linalg.solve(a + lam * np.eye(len(b)), b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: x in order with means y and weights n, to knots of a rising function."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([yi, ni, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            m = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / m, m, a[2], b[3]])
    knots = [(at, (b[0] * b[1] + 0.5) / (b[1] + 1)) for b in blocks for at in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


@dataclass(frozen=True)
class Model:
    phi: Fourier
    w: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.phi(m) @ self.w, self.x, self.y), 0, 1)


def fit(rows: DataFrame, size: int = 256, width: float = 3.0, lam: float = 0.1, seed: int = 11) -> Model | None:
    """A model of rows (y, FEATURES, f: a fold); None if there are none. Calibrated on scores of folds that were left out."""
    rows = cut(rows.select("y", "f", *FEATURES))
    stat = rows.agg(F.count("*"), *[F.avg(c) for c in FEATURES], *[F.stddev_pop(c) for c in FEATURES]).first()
    if not stat[0]:
        return None
    d = len(FEATURES)
    phi = Fourier.draw(np.array(stat[1 : d + 1], float), np.maximum(np.array(stat[d + 1 :], float), 1e-6), size, width, seed)
    few = rows.coalesce(LEARN_TASKS)
    parts = normal_equations(few, phi)
    final = ridge(list(parts.values()), lam)
    without = {k: ridge([p for j, p in parts.items() if j != k] or list(parts.values()), lam) for k in parts}
    out = pa.schema([("bin", pa.int64()), ("y", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, y, f = phi(_matrix(b)), b.column(b.schema.get_field_index("y")), b.column(b.schema.get_field_index("f")).to_numpy()
            s = np.zeros(len(f))
            for k in np.unique(f):
                s[f == k] = z[f == k] @ without[int(k)]
            yield record(out, np.round(np.clip(s, -1, 2) * BINS).astype(np.int64), y)

    bins = few.mapInArrow(scored, "bin bigint, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # 3 * BINS rows at most
    x, y = isotonic(*(np.array([b[i] for b in bins], float) for i in (0, 1, 2)))
    return Model(phi, final, x / BINS, y)


def train(docs: DataFrame, labels: DataFrame, held: Column, learn_rows: int = LEARN_ROWS, measured: bool = True) -> Model | None:
    """A model from the labels whose doc_id is not ``held`` and the documents: their FEATURES if ``measured``, else their texts, of which only labelled ones are measured.

    An id that repeats is learnt from once, by its row with the least features.
    """
    sample = labels_sample(labels, "quality", ~F.coalesce(held, F.lit(False)), learn_rows)
    few = maybe_broadcast(sample, sample.count(), 4 * learn_rows)
    if not measured:
        docs = document_stats(docs.select("doc_id", "text").join(few.select("doc_id"), "doc_id", "left_semi")).select("doc_id", *[c.cast("double").alias(f) for f, c in ratios().items()])
    rows = docs.join(few, "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("r")).select("doc_id", "r.*")
    return fit(rows.withColumn("f", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")))


def score_quality(docs: DataFrame, labels: DataFrame, held: Column, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, score) of each document: the calibrated chance that its quality label is 1.

    Learns from labels whose doc_id is not ``held``. Needs doc_id and text of documents, doc_id and quality
    of labels; other columns are ignored. Null and empty texts get the score of a text without words, null
    and repeated ids are scored row by row. A very long text is held whole by one task. With no label to learn
    from, every score is 0.5; an empty table gives no rows.
    """
    rows = cut(document_stats(docs).select("doc_id", *[c.cast("double").alias(f) for f, c in ratios().items()]))
    model = train(rows, labels, held, learn_rows)
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record(out, b.column(0), model(_matrix(b)))

    return mapped(rows, ["doc_id", *FEATURES], run, "doc_id bigint, score double")


def held_out(docs_id: str | Column = "doc_id") -> Column:
    """Rows that quality is never learnt from: crc32 of the id as text mod 4 is 2."""
    return fold(docs_id, 4) == 2


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """The documents, all columns, whose score is the threshold at least; each row is judged by its own text. All stay where there is no label to learn from."""
    model = train(docs, labels, held_out(), learn_rows, measured=False)
    if model is None:
        return docs
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                yield p.filter(pa.array(model(ratio_matrix(measure(p.column(text)))) >= threshold))

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, docs.schema)  # whatever their names hold
