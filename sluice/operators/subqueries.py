"""Quantified comparisons with a subquery, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPS = {"=": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
#: x op ANY(s) for an ordering op compares with the least or greatest of s; ALL with the other one.
_EDGE = {"<": ("max", "min"), "<=": ("max", "min"), ">": ("min", "max"), ">=": ("min", "max")}


def _test(op: str, a, b):
    return {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _edge(df: DataFrame, col: str, op: str, sub: DataFrame, value: str, which: int, empty: bool) -> DataFrame:
    s = sub.agg(getattr(F, _EDGE[op][which])(value).alias("_edge"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"))
    hit = _test(op, F.col(col), F.col("_edge"))
    keep = F.when(F.col("_n") == 0, F.lit(empty)).otherwise(hit if which == 0 else hit & (F.col("_n") == F.col("_known")))
    return df.join(F.broadcast(s)).where(keep).drop("_edge", "_n", "_known")  # s is one row


def compare_any(df: DataFrame, col: str, op: str, sub: DataFrame, value: str) -> DataFrame:
    """Rows for which ``col op ANY (sub.value)`` is true; an empty subquery gives none."""
    if op == "=":
        return df.join(sub.select(F.col(value).alias("_v")), F.col(col) == F.col("_v"), "left_semi")
    if op in _EDGE:
        return _edge(df, col, op, sub, value, 0, False)
    two = sub.select(value).where(F.col(value).isNotNull()).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(F.broadcast(two)).where((F.col(col) != F.col("_lo")) | (F.col(col) != F.col("_hi"))).drop("_lo", "_hi")


def compare_all(df: DataFrame, col: str, op: str, sub: DataFrame, value: str) -> DataFrame:
    """Rows for which ``col op ALL (sub.value)`` is true; an empty subquery gives all, a null in it none that it could decide."""
    if op in _EDGE:
        return _edge(df, col, op, sub, value, 1, True)
    if op == "=":
        s = sub.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"))
        keep = (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & (F.col(col) == F.col("_lo")) & (F.col(col) == F.col("_hi")))
        return df.join(F.broadcast(s)).where(keep).drop("_lo", "_hi", "_n", "_known")
    view, right = "_all_left", "_all_right"
    df.createOrReplaceTempView(view)
    sub.select(F.col(value).alias("_v")).createOrReplaceTempView(right)
    return df.sparkSession.sql(f"SELECT * FROM {view} WHERE `{col}` NOT IN (SELECT _v FROM {right})")
