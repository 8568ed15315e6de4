"""Connected components of an edge table, by alternating large and small stars; a table that one task can hold is done in one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut

#: Edges up to which one task joins them (some 100 bytes each); the rounds of stars are a dozen queries or more,
#: whose plans, code and threads cost the driver hundreds of MB in all, however few the edges.
ONE_TASK = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches) of edges: roots hook to the least root next to them until none differ."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (x, y) = np.arange(len(nodes)), at.reshape(2, -1)
    while (up[x] != up[y]).any():
        np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have = [b for b in batches if b.num_rows]
    if have:
        node, component = joined(*(np.concatenate([b.column(i).to_numpy() for b in have]) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])


def _star(neighbours: DataFrame, own: bool) -> DataFrame:
    """Edges (a, m): m the least of u and its neighbours, for the neighbours above u (own: below it, and for u)."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = neighbours.join(least, "u")
    out = joined.where("v != m" if own else "v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node it reaches.

    Loops and repeated edges are ignored, as are edges with a null end. Each round is written out, so a
    lost executor costs one round at most; up to ``ONE_TASK`` edges need no rounds. A hub's neighbours are joined to their least one, which
    adaptive execution can split; they are never gathered.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= ONE_TASK:
        return cut(e.coalesce(1).mapInArrow(_whole, "node bigint, component bigint"))
    seen = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, False)
        e = cut(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
