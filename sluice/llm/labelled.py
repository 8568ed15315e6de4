"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut

_STEPS = 1 << 20


def labels_sample(labels: DataFrame, label: str, use: Column, most: int) -> DataFrame:
    """(doc_id, y): labels where ``use`` holds, averaged by document; about ``most`` of them, by a hash of the id, where there are more.

    Null ids and labels are left out.
    """
    rows = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & use)
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id")), F.lit(_STEPS)) < int(_STEPS * most / n))
    return cut(rows.groupBy("doc_id").agg(F.avg("y").alias("y")))
