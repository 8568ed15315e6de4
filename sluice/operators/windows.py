"""Window helpers for what the DataFrame API doesn't spell: GROUPS frames and IGNORE NULLS offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str], start: int, end: int, **aggs) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end: peers are numbered by dense_rank, and the frame is a range of numbers.

    ``aggs`` maps a name to fn(column name), applied as ``fn(col).over(frame)`` to pairs (fn, col). Offsets are
    like those of rowsBetween.
    """
    numbered = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return numbered.withColumns({name: fn(col).over(w) for name, (fn, col) in aggs.items()}).drop("_group")


def offset_ignoring_nulls(kind: str, col: str, n: int, partition: list[str], order: list[str]) -> Column:
    """lag or lead over non-null values."""
    part = ("PARTITION BY " + ", ".join(partition)) if partition else ""
    return F.expr(f"{kind}({col}, {int(n)}) IGNORE NULLS OVER ({part} ORDER BY {', '.join(order)})")


def running(partition: list[str], order: list[str]) -> WindowSpec:
    """ROWS UNBOUNDED PRECEDING."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def remaining(partition: list[str], order: list[str]) -> WindowSpec:
    """RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING, for aggregates that don't hang on the order of rows.

    Spark reads such a frame from a partition's start again for each row. The rows that don't come before this one
    are those up to it and its peers in the opposite order (nulls at the opposite end), which takes one pass.
    """
    return Window.partitionBy(*partition).orderBy(*[F.col(c).desc_nulls_last() for c in order]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
