"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import scratch


def global_row_number(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """Adds the row's place (from 1) in the order of ``keys`` (names or sort columns), which should be unique.

    Rows are range-partitioned, ranked in each partition and written out, as ranges that were sampled again
    would be others; partition counts, one row each, give the offsets.
    """
    part, place, n = (f"{name}_{x}" for x in ("part", "place", "n"))
    local = Window.partitionBy(part).orderBy(*keys)
    at = scratch(df.sparkSession)
    df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()).withColumn(place, F.row_number().over(local)).write.parquet(at)
    ranked = df.sparkSession.read.parquet(at)
    counts = ranked.groupBy(part).agg(F.count("*").alias(n))
    before = counts.select(part, (F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col(n)).alias(n))
    return ranked.join(F.broadcast(before), part).withColumn(name, F.col(place) + F.col(n)).drop(part, place, n)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET of an ordered frame."""
    return df.offset(offset).limit(limit)
