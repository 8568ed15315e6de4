"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample and fit in memory with a neighbour graph over
them, which a beam search walks to place vectors and queries. A vector near a boundary is listed in several
clusters. A query reads the lists whose centroids lie within a ratio of its nearest one, of a share of all
lists at most. Long lists are split by a hash of the vector and the queries of a list by a hash of theirs, so
a popular region is many groups.

Vectors that are equal are indexed once, with the least of their ids that any answer can need (k + 1 of
them), and queries that are equal are searched once. Both are exact, and a hot vector costs one entry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut

#: Distinct vectors that centroids are learnt from, at most (by a hash of the vector), and centroids, at most.
SAMPLE, MOST_LISTS = 24_000, 2048
#: Share of the lists that a query may read, and the fewest; a fixed number would lose recall as the lists grow.
SHARE, BEAM = 0.22, 96
#: Queries of the sample that the ratio is learnt from, and the share of their neighbours that it must reach.
TRIALS, REACHED = 256, 0.99
#: Distinct vectors a list should have, and vectors and queries of a list that meet at once, about.
LIST, PART, ASKED = 96, 4096, 8192
DEGREE, ENTRIES = 24, 32


@dataclass(frozen=True)
class Graph:
    """Centroids, the nearest neighbours of each, and a few spread-out ones to start from."""

    at: np.ndarray
    near: np.ndarray
    entry: np.ndarray

    @staticmethod
    def build(at: np.ndarray, seed: int = 5) -> Graph:
        n = len(at)
        k = min(DEGREE, n - 1)
        near = np.empty((n, max(k, 1)), np.int32)
        sq = (at * at).sum(1)
        for lo in range(0, n, 1024):
            d = sq[lo : lo + 1024, None] - 2 * at[lo : lo + 1024] @ at.T + sq
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near[lo : lo + 1024] = np.argsort(d, 1)[:, : max(k, 1)] if k else 0
        return Graph(at, near, np.sort(np.random.default_rng(seed).permutation(n)[:ENTRIES]))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the ``beam`` nearest to each row of x, nearest first."""
        m, beam = len(x), min(beam, len(self.at))
        dist = lambda ids: ((self.at[ids] - x[:, None, :]) ** 2).sum(2)
        ids = np.tile(self.entry, (m, 1))
        d = dist(ids)
        visited = np.zeros((m, len(self.at)), bool)
        visited[:, self.entry] = True
        done = np.zeros(ids.shape, bool)
        row = np.arange(m)[:, None]
        for _ in range(4 * beam + 16):
            order = np.argsort(d, 1, kind="stable")[:, :beam]
            ids, d, done = ids[row, order], d[row, order], done[row, order]
            todo = np.where(done | ~np.isfinite(d), np.inf, d)
            best = todo.argmin(1)
            if not np.isfinite(todo[np.arange(m), best]).any():
                break
            done[np.arange(m), best] = True
            new = self.near[ids[np.arange(m), best]]
            nd = np.where(visited[row, new] | ~np.isfinite(todo[np.arange(m), best])[:, None], np.inf, dist(new))
            visited[row, new] = True
            ids, d, done = np.hstack([ids, new]), np.hstack([d, nd]), np.hstack([done, np.zeros(new.shape, bool)])
        order = np.argsort(d, 1, kind="stable")[:, :beam]
        return ids[row, order], d[row, order]


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Balanced k-means: a cluster's distance grows with its size over the mean; empty clusters restart at far rows."""
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        own, far = np.empty(len(x), np.int64), np.empty(len(x))
        scale = None
        for lo in range(0, len(x), 4096):
            b = x[lo : lo + 4096]
            d = (b * b).sum(1)[:, None] - 2 * b @ at.T + (at * at).sum(1)
            scale = float(np.median(d.min(1))) if scale is None else scale
            c = (d + 0.1 * scale * (size * k / len(x) - 1)).argmin(1)
            own[lo : lo + 4096], far[lo : lo + 4096] = c, d[np.arange(len(b)), c]
        size = np.bincount(own, minlength=k).astype(float)
        total = np.zeros_like(at)
        np.add.at(total, own, x)
        at = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], at)
        empty = np.flatnonzero(size == 0)
        at[empty] = x[np.argsort(-far)[: len(empty)]]
    return at


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def pruning_ratio(x: np.ndarray, at: np.ndarray, k: int, copies: int, spread: float, seed: int = 9) -> float:
    """The ratio to a query's nearest centroid within which lists hold REACHED of its neighbours, by brute force over a sample."""
    if len(x) < 2 or len(at) < 2:
        return 1.0
    q = np.random.default_rng(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
    d = _distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(d, k - 1, 1)[:, :k]
    asked = _distances(x[q], at)
    asked /= np.maximum(asked.min(1, keepdims=True), 1e-9)
    home = _distances(x[near.ravel()], at)
    own = np.argsort(home, 1, kind="stable")[:, :copies]
    mine = np.take_along_axis(home, own, 1) <= spread * home.min(1, keepdims=True) + 1e-12
    need = np.where(mine, np.take_along_axis(np.repeat(asked, k, 0), own, 1), np.inf).min(1)
    return float(np.quantile(need, REACHED))


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, empty or zero, and each component a finite number."""
    c = F.col(vector)
    return F.coalesce(
        c.isNotNull() & F.forall(c, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(c, lambda v: F.coalesce(v != 0, F.lit(False))),
        F.lit(False),
    )


def _rows(a: pa.ChunkedArray, dim: int) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, beam: int | None = None, ratio: float | None = None, copies: int = 4, spread: float = 1.1, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance in double precision.

    Needs vec_id and embedding; other columns are ignored. Queries are the rows where ``is_query`` holds;
    every row but those of the query's own id is a candidate. Rows with a null id take no part, nor do
    vectors that are null, zero, not of the commonest size, or hold a null or non-finite component. Where an
    id repeats with other vectors, it is near by its nearest one. Ties go to the smaller vec_id. Fewer
    candidates than k are all returned; an empty table gives no rows. ``ratio`` and ``spread`` compare
    distances with that to the nearest centroid, for the lists a query reads and a vector is put in; the first is
    learnt from the sample where none is given. ``beam`` is the most lists that a query reads; by default a share
    of all (near-uniform vectors of many dimensions have most centroids within the ratio).
    """
    spark = vectors.sparkSession
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable("v") & F.col("vec_id").isNotNull())
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = dims[0]
    good = cut(good.where(F.size("v") == dim).withColumn("h", F.xxhash64("v")))
    ids = Window.partitionBy("h", "v").orderBy("vec_id")
    fewest = good.select("h", "v", "vec_id").distinct().withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1)  # limited before the shuffle, too
    classes = cut(fewest.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = classes.count()
    part = classes if n <= sample else classes.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * sample / n))
    learn = _rows(part.select("v").toArrow()["v"], dim)  # about ``sample`` rows
    lists = max(1, min(MOST_LISTS, n // LIST, len(learn) // 8))
    beam = beam or max(BEAM, math.ceil(SHARE * lists))
    graph = Graph.build(centroids(learn, lists))
    ratio = ratio or pruning_ratio(learn, graph.at, k, copies, spread)
    del learn

    def placed(most: int, within: float, wide: int):
        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    s = b.slice(lo, 1024)
                    at, d = graph.search(_rows(s.column(0), dim), wide)
                    keep = np.sqrt(d[:, :most]) <= within * np.sqrt(d[:, :1]) + 1e-12
                    row, col = np.nonzero(keep)
                    t = s.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(at[row, col], pa.int32())], [*s.schema.names, "list"])

        return run

    posted = cut(classes.select("v", "h", "ids").mapInArrow(placed(copies, spread, 16), "v array<double>, h bigint, ids array<bigint>, list int"))
    parts = F.broadcast(cut(posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))))  # MOST_LISTS rows at most
    asked = cut(good.where("q").select("v", "h", "vec_id"))
    queries = asked.groupBy("h", "v").agg(F.min("vec_id").alias("qc"))
    queries = cut(queries.select("v", "qc").mapInArrow(placed(beam, ratio, beam), "v array<double>, qc bigint, list int"))
    turns = F.broadcast(cut(queries.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.join(parts, "list").join(turns, "list").withColumn("part", F.pmod("h", F.col("parts")).cast("int")).withColumn("turn", every("turns"))
    queries = queries.join(parts, "list").join(turns, "list").withColumn("turn", F.pmod(F.xxhash64("qc"), F.col("turns")).cast("int")).withColumn("part", every("parts"))
    queries = queries.select("list", "part", "turn", "qc", "v")
    out = pa.schema([("qc", pa.int64()), ("h", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def compare(post: pa.Table, ask: pa.Table) -> pa.Table:
        if not post.num_rows or not ask.num_rows:
            return out.empty_table()
        x, q = _rows(post["v"], dim), _rows(ask["v"], dim)
        first = pa.compute.list_element(post["ids"], 0).to_numpy()
        sq, rows, cols, score = (x * x).sum(1), [], [], []
        most = min(len(x), k + 2)
        for lo in range(0, len(q), 256):
            b = q[lo : lo + 256]
            d = sq - 2 * b @ x.T
            edge = np.partition(d, most - 1, 1)[:, most - 1 :  most]
            slack = 1e-11 * (sq.max() + (b * b).sum(1)[:, None])  # more than rounding can move a distance
            r, c = np.nonzero(d <= edge + slack)  # all that may be at the cut-off distance, or nearer
            exact = np.sqrt(((x[c] - b[r]) ** 2).sum(1))
            order = np.lexsort((first[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < most
            rows.append(r[best] + lo)
            cols.append(c[best])
            score.append(exact[best])
        rows, cols = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table([ask["qc"].take(rows), post["h"].take(cols), post["ids"].take(cols), pa.array(np.concatenate(score))], schema=out)

    met = posted.select("list", "part", "turn", "v", "h", "ids").groupBy("list", "part", "turn").cogroup(queries.groupBy("list", "part", "turn")).applyInArrow(compare, "qc bigint, h bigint, ids array<bigint>, score double")
    best = Window.partitionBy("qc").orderBy("score", F.col("ids")[0])
    met = met.groupBy("qc", "h", "ids").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    asked = asked.join(asked.groupBy("h", "v").agg(F.min("vec_id").alias("qc")), ["h", "v"]).select("qc", F.col("vec_id").alias("query_id"))
    found = asked.distinct().join(met.select("qc", F.explode("ids").alias("vec_id"), "score"), "qc").where("vec_id != query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
