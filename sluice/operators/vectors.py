"""Vector distances as built-in expressions, exact and inverted-file nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def vector(x) -> Column:
    """A column, a name or a list of numbers as an array of doubles."""
    if isinstance(x, (list, tuple)):
        return F.array(*[F.lit(float(v)) for v in x])
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(vector(a), vector(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(vector(a), lambda x: x * x)))


def squared_l2(a, b) -> Column:
    return _sum(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n != 0, n))


def normalize(a) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, vector(a)).otherwise(F.transform(vector(a), lambda x: x / F.when(n != 0, n)))


def score(a, b, metric: str) -> Column:
    """Smaller is nearer: squared distance, 1 - cosine, or minus the dot product."""
    return {"euclidean": squared_l2, "cosine": lambda x, y: 1 - cosine(x, y), "dot": lambda x, y: -dot(x, y)}[metric](a, b)


def checked(df: DataFrame, col: str, dim: int) -> DataFrame:
    """The frame; a vector of another size fails the query."""
    return df.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(F.raise_error(F.concat(F.lit("vector size "), F.size(col).cast("string")))))


def exact(df: DataFrame, query: list[float], k: int, metric: str = "euclidean", key: str = "vec_id", col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(key, score) of the k nearest rows that the filter lets through, nearest first."""
    rows = df if where is None else df.where(where)
    return rows.select(key, score(col, query, metric).alias("score")).orderBy("score", key).limit(k)


def exact_many(df: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", col: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, key, score, rank) of the k nearest rows of each query (same columns as ``df``).

    Queries go in blocks of a fixed size, each one pass over the rows; the k best of a task are kept before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy("score", key)

    def search(some: list) -> DataFrame:
        q = F.array(*[F.struct(F.lit(r[0]).cast("bigint").alias("query_id"), vector(list(r[1])).alias("q")) for r in some])
        rows = df.select(key, col, F.explode(q).alias("x")).select(F.col("x.query_id").alias("query_id"), key, score(col, F.col("x.q"), metric).alias("score"))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    out, some = None, []
    for r in queries.select(key, col).toLocalIterator():
        some.append(r)
        if len(some) == block:
            out, some = search(some) if out is None else out.unionByName(search(some)), []
    if some or out is None:
        last = search(some) if some else search([(0, [0.0])]).limit(0)
        out = last if out is None else out.unionByName(last)
    return out


@dataclass
class InvertedFile:
    """Vectors by their nearest centroid. ``lists`` has key, vector and cluster; centroids are few and stay with the driver."""

    lists: DataFrame
    centroids: list[list[float]]
    metric: str
    key: str
    col: str

    @staticmethod
    def build(df: DataFrame, clusters: int | None = None, metric: str = "euclidean", key: str = "vec_id", col: str = "embedding", seed: int = 7) -> InvertedFile:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.withColumn("_v", array_to_vector(normalize(col) if metric == "cosine" else vector(col)))
        n = clusters or max(1, int(df.count() ** 0.5))
        model = KMeans(k=n, maxIter=20, tol=1e-2, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
        return InvertedFile(model.transform(rows).drop("_v"), [list(map(float, c)) for c in model.clusterCenters()], metric, key, col)

    def write(self, path: str) -> None:
        """One folder a cluster, so a search reads only what it probes."""
        self.lists.write.partitionBy("cluster").parquet(path)

    def search(self, query: list[float], k: int, probes: int = 3, where: Column | None = None) -> DataFrame:
        """The k nearest rows of the ``probes`` nearest clusters; with all of them the result is exact."""
        q = query
        if self.metric == "cosine":
            n = sum(x * x for x in q) ** 0.5 or 1.0
            q = [x / n for x in q]
        near = sorted(range(len(self.centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.centroids[i], q)))[:probes]
        return exact(self.lists.where(F.col("cluster").isin(near)), query, k, self.metric, self.key, self.col, where)


def search(df: DataFrame, query: list[float], k: int, index: InvertedFile | None = None, probes: int = 3, **options) -> DataFrame:
    """By the index if there is one, else exact."""
    return index.search(query, k, probes, options.get("where")) if index else exact(df, query, k, **options)


def hashed_embedding(text, dim: int = 64) -> Column:
    """A text as hashed term counts of length 1: the offline stand-in for an embedding model."""
    from sluice.operators.fulltext import tokens

    slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return normalize(counts)


def latest(puts: DataFrame, key: str = "id", sequence: str = "sequence", operation: str = "operation") -> DataFrame:
    """State after all changes: each key's last one, unless it deletes."""
    cols = [c for c in puts.columns if c != key]
    last = puts.groupBy(key).agg(F.max_by(F.struct(*cols), sequence).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).where(F.col(operation) != "delete")


def reference(spark: SparkSession, df: DataFrame, key: int, name: str = "vec_id", col: str = "embedding") -> list[float]:
    """The stored vector of one id."""
    return [float(x) for x in df.where(F.col(name) == key).select(col).first()[0]]
