"""Table loading: lazily opened Parquet relations, addressed by name under one folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """Temp views over the named tables, for queries written as SQL."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
