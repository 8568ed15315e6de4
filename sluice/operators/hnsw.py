"""A navigable small-world graph index in shards: each shard's graph is built by one task and kept as one row.

A graph over a whole table can't be distributed, so vectors are dealt to shards by a hash of their id; a search
asks every shard for its best and merges them. Rows added later make shards of their own, and deletes are
marks that searches skip. A shard's size bounds the memory of a task.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Neighbours of a node (twice as many on the lowest layer), and candidates held while building and searching.
M, EF_BUILD, EF_SEARCH = 16, 200, 128
_SHARD = "shard string, n int, graph binary"


def default_m(dim: int) -> int:
    """Wide vectors get more neighbours."""
    return max(M, dim // 48) if dim >= 768 else M


class Graph:
    """Layers of neighbour lists over vectors; distances are squared Euclidean."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7):
        self.x, self.m, self.ef = np.ascontiguousarray(x, np.float64), m, ef
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry = -1
        top = np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(len(x)), 1e-12)) / np.log(max(m, 2))).astype(int)
        for i in range(len(x)):
            self._add(i, int(top[i]))

    def _far(self, q: np.ndarray, ids) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _closest(self, q: np.ndarray, start: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        """About the ef nearest nodes of a layer that a greedy walk from ``start`` meets, nearest first."""
        links, seen = self.layers[layer], set(start)
        todo = [(float(d), i) for d, i in zip(self._far(q, start), start)]
        best = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in links[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._far(q, new).tolist(), new):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one goes in if nothing chosen is nearer to it than the node itself; the nearest fill up."""
        out: list[int] = []
        for d, i in found:
            if len(out) == most:
                break
            if not out or self._far(self.x[i], out).min() > d:
                out.append(i)
        have = set(out)
        return out + [i for _, i in found if i not in have][: most - len(out)]

    def _add(self, i: int, top: int) -> None:
        old = len(self.layers) - 1
        while len(self.layers) <= top:
            self.layers.append({})
        start = [self.entry]
        for layer in range(old, top, -1):
            start = [self._closest(self.x[i], start, layer, 1)[0][1]]
        for layer in range(min(top, old), -1, -1):
            found = self._closest(self.x[i], start, layer, self.ef)
            most = self.m * (2 if layer == 0 else 1)
            mine = self._chosen(found, self.m)
            links = self.layers[layer]
            links[i] = np.array(mine, np.int32)
            for j in mine:
                all_ = np.append(links[j], np.int32(i))
                if len(all_) > most:
                    d = self._far(self.x[j], all_)
                    order = np.argsort(d, kind="stable")
                    all_ = np.array(self._chosen([(float(d[k]), int(all_[k])) for k in order], most), np.int32)
                links[j] = all_
            start = [k for _, k in found]
        for layer in range(max(old, -1) + 1, top + 1):
            self.layers[layer][i] = np.zeros(0, np.int32)
        if top > old:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(squared distance, node) of the k nearest found; where ``allowed`` lets few through, the search widens until it has k or all."""
        if self.entry < 0:
            return []
        q = np.asarray(q, np.float64)
        start = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = [self._closest(q, start, layer, 1)[0][1]]
        ef = max(ef, k)
        while True:
            found = self._closest(q, start, 0, ef)
            good = [(d, i) for d, i in found if allowed is None or allowed[i]]
            if len(good) >= k or ef >= len(self.x):
                return good[:k]
            ef *= 4

    def dump(self, ids: np.ndarray) -> bytes:
        out = {"x": self.x, "ids": ids, "entry": np.array([self.entry]), "m": np.array([self.m])}
        for n, layer in enumerate(self.layers):
            nodes = np.array(list(layer), np.int32)
            out |= {f"n{n}": nodes, f"c{n}": np.array([len(layer[i]) for i in nodes.tolist()], np.int32), f"l{n}": np.concatenate([layer[i] for i in nodes.tolist()] or [np.zeros(0, np.int32)])}
        buf = io.BytesIO()
        np.savez(buf, **out)
        return buf.getvalue()

    @staticmethod
    def load(blob: bytes) -> tuple[Graph, np.ndarray]:
        a = np.load(io.BytesIO(blob))
        g = object.__new__(Graph)
        g.x, g.m, g.ef, g.entry, g.layers = a["x"], int(a["m"][0]), EF_BUILD, int(a["entry"][0]), []
        while f"n{len(g.layers)}" in a:
            n = len(g.layers)
            g.layers.append(dict(zip(a[f"n{n}"].tolist(), np.split(a[f"l{n}"], np.cumsum(a[f"c{n}"])[:-1]))))
        return g, a["ids"]


@dataclass(frozen=True)
class Hnsw:
    """The index: a row a shard under ``at``; ``deleted`` has the ids that searches skip, by shard."""

    spark: SparkSession
    at: str
    deleted: DataFrame
    key: str = "vec_id"
    col: str = "embedding"

    @staticmethod
    def _graphs(rows: DataFrame, key: str, col: str, name: str, shard_rows: int, m: int | None, ef: int) -> DataFrame:
        shards = max(1, -(-rows.count() // shard_rows))

        def build(t: pd.DataFrame) -> pd.DataFrame:
            t = t.drop_duplicates("id").sort_values("id")
            x = np.stack(t["v"].to_numpy())
            return pd.DataFrame([(t["shard"].iloc[0], len(t), Graph(x, m or default_m(x.shape[1]), ef).dump(t["id"].to_numpy()))], columns=["shard", "n", "graph"])

        part = F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("string"))
        slim = rows.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(part.alias("shard"), F.col(key).cast("bigint").alias("id"), F.col(col).cast("array<double>").alias("v"))
        return slim.groupBy("shard").applyInPandas(build, _SHARD)

    @staticmethod
    def build(df: DataFrame, at: str, key: str = "vec_id", col: str = "embedding", shard_rows: int = 4096, m: int | None = None, ef: int = EF_BUILD) -> Hnsw:
        """Graphs of about ``shard_rows`` vectors each; null ids and vectors stay out, an id that repeats is indexed once."""
        Hnsw._graphs(df, key, col, "0", shard_rows, m, ef).write.parquet(at)
        return Hnsw(df.sparkSession, at, df.sparkSession.createDataFrame([], "shard string, id bigint"), key, col)

    def _ids(self) -> DataFrame:
        """(shard, id) of what is indexed and not deleted."""
        ids = lambda it: (pd.DataFrame({"shard": s, "id": np.load(io.BytesIO(g))["ids"]}) for t in it for s, g in zip(t["shard"], t["graph"]))
        have = self.spark.read.parquet(self.at).select("shard", "graph").mapInPandas(ids, "shard string, id bigint")
        return have.join(self.deleted, ["shard", "id"], "left_anti")

    def insert(self, df: DataFrame, name: str, shard_rows: int = 4096) -> Hnsw:
        """With these rows in shards of their own; an id that is live stays as it is, one that was deleted comes back with its new vector."""
        new = df.join(self._ids().select(F.col("id").alias(self.key)), self.key, "left_anti")
        Hnsw._graphs(new, self.key, self.col, name, shard_rows, None, EF_BUILD).write.mode("append").parquet(self.at)
        return self

    def delete(self, ids: DataFrame) -> Hnsw:
        """Without these ids (the first column), which stay in their graphs as ways to others."""
        return replace(self, deleted=self.deleted.union(self._ids().join(ids.select(F.col(ids.columns[0]).alias("id")), "id").select("shard", "id")))

    def search(self, queries: DataFrame, k: int, ef: int = EF_SEARCH, where: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, key, score) for queries (query_id, v): squared Euclidean distance, nearest first, ties to smaller keys.

        ``where``: the only ids (its first column) that may be found. Every shard answers every query with its
        k best, so what is merged is k rows a query and shard.
        """
        skip = self.deleted.groupBy("shard").agg(F.collect_set("id").alias("gone"))
        shards = self.spark.read.parquet(self.at).join(skip, "shard", "left")
        if where is not None:
            homes = self._ids().join(where.select(F.col(where.columns[0]).alias("id")).distinct(), "id").groupBy("shard").agg(F.collect_set("id").alias("good"))
            shards = shards.join(homes, "shard")
        else:
            shards = shards.withColumn("good", F.lit(None).cast("array<bigint>"))

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for graph, gone, good in zip(left["graph"], left["gone"], left["good"]):
                g, ids = Graph.load(graph)
                allowed = np.ones(len(ids), bool)
                if gone is not None:
                    allowed &= ~np.isin(ids, gone)
                if good is not None:
                    allowed &= np.isin(ids, good)
                for q, v in zip(right["query_id"], right["v"]):
                    out += [(q, int(ids[i]), d) for d, i in g.search(np.asarray(v), k, ef, allowed)]
            return pd.DataFrame(out, columns=["query_id", "id", "score"])

        blocks = queries.select("query_id", F.col("v").cast("array<double>").alias("v"))
        names = shards.select(F.col("shard").alias("home")).distinct()  # one row a shard
        asked = blocks.join(F.broadcast(names), how="cross")
        found = shards.groupBy("shard").cogroup(asked.groupBy("home")).applyInPandas(ask, "query_id bigint, id bigint, score double")
        best = Window.partitionBy("query_id").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(self.key), "score")


@dataclass
class Collection:
    """Records by id with a vector: get, upsert, delete and filtered search, each on the state that the last change left."""

    rows: DataFrame
    key: str = "id"
    col: str = "embedding"

    def get(self, *ids: int) -> DataFrame:
        return self.rows.where(F.col(self.key).isin(list(ids)))

    def where(self, on: Column, top: int | None = None) -> DataFrame:
        out = self.rows.where(on).orderBy(self.key)
        return out.limit(top) if top else out

    def upsert(self, rows: DataFrame) -> Collection:
        return replace(self, rows=self.rows.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def delete(self, *ids: int) -> Collection:
        return replace(self, rows=self.rows.where(~F.col(self.key).isin(list(ids))))

    def search(self, query: list[float], top: int, on: Column | None = None, metric: str = "euclidean") -> DataFrame:
        from sluice.operators import vectors

        return vectors.exact(self.rows, query, top, metric, self.key, self.col, on)
