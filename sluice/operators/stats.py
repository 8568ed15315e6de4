"""Column statistics: null fraction, distinct values, common values and equi-depth histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_COMMON, BUCKETS = 32, 64


def summary(df: DataFrame, col: str, exact: bool = False) -> DataFrame:
    """One row: rows, share of nulls, distinct values (estimated unless ``exact``), least and greatest."""
    distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.when(F.col(col).isNull(), 1.0).otherwise(0.0)), 6).alias("null_fraction"),
        distinct.alias("distinct_values"), F.min(col).alias("lo"), F.max(col).alias("hi"))


def most_common(df: DataFrame, col: str, n: int = MOST_COMMON) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def equi_depth(df: DataFrame, col: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, lo, hi, n) of buckets with equal counts, ties parted by ``key``.

    Ranks come from a range partitioning and partition counts, so no task sorts the whole column.
    """
    from sluice.operators.sorting import global_row_number

    ranked = global_row_number(df.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), F.col(key).alias("k")), ["v", "k"], "r")
    n = ranked.count()
    small, wide = n // buckets, n % buckets  # the first buckets hold one more
    edge = wide * (small + 1)
    r = F.col("r") - 1
    bucket = F.when(r < edge, F.expr(f"(r - 1) div {small + 1}")).otherwise(wide + F.expr(f"(r - 1 - {edge}) div {max(small, 1)}")) + 1
    return ranked.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
