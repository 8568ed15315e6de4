"""Hybrid search: text candidates, ranked again by their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import fulltext, vectors


def search(docs: DataFrame | fulltext.TextIndex, vecs: DataFrame, text_query: str, vector_query: list[float], k: int, candidates: int = 100, key: str = "doc_id", text: str = "text", vec_key: str = "vec_id", vec: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(key, vector_score, text_score): the best ``candidates`` by BM25 (of a table or a text index), nearest vectors first, then better texts, then keys."""
    found = docs.search(text_query, candidates) if isinstance(docs, fulltext.TextIndex) else fulltext.bm25(docs, key, text, text_query, candidates)
    scored = vecs.join(F.broadcast(found), vecs[vec_key] == found[key])  # ``candidates`` rows
    out = scored.select(key, F.round(vectors.score(vec, vector_query, metric), 6).alias("vector_score"), F.col("score").alias("text_score"))
    return out.orderBy("vector_score", F.desc("text_score"), key).limit(k)
