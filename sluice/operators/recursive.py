"""Recursive queries that keep distinct rows: semi-naive iteration to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

MAX_ITERATIONS = 1000


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """anchor UNION step(step(...)): each round expands only rows that are new, until none is.

    Rounds are checkpointed (spark.checkpoint.dir), so the plan doesn't grow with their number.
    """
    from sluice.session import scratch

    spark = anchor.sparkSession
    at, found, new = scratch(spark), None, anchor.distinct()
    for i in range(max_iterations):
        new.write.parquet(f"{at}/{i}")
        new = spark.read.parquet(f"{at}/{i}")
        if new.isEmpty():
            return found if found is not None else new
        found = new if found is None else spark.read.parquet(*[f"{at}/{k}" for k in range(i + 1)])
        new = step(new).toDF(*found.columns).subtract(found)
    raise RuntimeError(f"the recursion did not end in {max_iterations} rounds")
