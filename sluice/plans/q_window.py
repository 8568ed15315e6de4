"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.plans.registry import op, sql_op
from sluice.sources.tables import table

_O = "FROM orders"
_W = "PARTITION BY o_custkey ORDER BY o_orderkey"


def _w(name: str, expr: str, spark_expr: str | None = None, over: str = _W, src: str = _O) -> None:
    q = "SELECT o_orderkey, {} AS v {}"
    oracle = q.format(expr if "OVER" in expr else f"{expr} OVER ({over})", src)
    mine = spark_expr or expr
    mine = q.format(mine if "OVER" in mine else f"{mine} OVER ({over})", src)
    sql_op(name, mine, oracle)


def _i(name: str, expr: str, over: str = _W) -> None:
    _w(name, f"CAST({expr} OVER ({over}) AS BIGINT)")


_i("win_01_row_number", "row_number()")
_i("win_02_rank", "rank()", "PARTITION BY o_custkey % 20 ORDER BY o_orderstatus")
_i("win_03_dense_rank", "dense_rank()", "PARTITION BY o_custkey % 20 ORDER BY o_orderstatus")
_i("win_04_ntile", "ntile(4)")
_w("win_05_percent_rank", "percent_rank()", over="PARTITION BY o_custkey % 20 ORDER BY o_orderpriority")
_w("win_06_cume_dist", "cume_dist()", over="PARTITION BY o_custkey % 20 ORDER BY o_orderpriority")
_w("win_07_aggregates", f"count(*) OVER ({_W}) AS n, min(o_totalprice) OVER ({_W}) AS lo, max(o_totalprice) OVER ({_W})")
_w("win_07_sum", f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_W}) AS DOUBLE)")
_w("win_08_lag", f"lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_W})")
_w("win_09_lead", "lead(o_orderkey)")
_w("win_10_first_value", "first_value(o_orderkey)")
_w("win_11_last_value", "last_value(o_orderpriority)", over="PARTITION BY o_custkey % 20 ORDER BY o_orderpriority")
_w("win_12_nth_value", "nth_value(o_orderkey, 3)")
_w("win_13_first_ignore_nulls", f"first_value(nullif(o_orderstatus, 'F') IGNORE NULLS) OVER ({_W})", f"first_value(nullif(o_orderstatus, 'F')) IGNORE NULLS OVER ({_W})")
_w("win_13_nth_ignore_nulls", f"nth_value(nullif(o_orderstatus, 'F'), 2 IGNORE NULLS) OVER ({_W})", f"nth_value(nullif(o_orderstatus, 'F'), 2) IGNORE NULLS OVER ({_W})")
_w("win_14_default_frame", "count(*)", over="PARTITION BY o_custkey % 20 ORDER BY o_orderpriority")
_w("win_14_whole_partition", "count(*)", over="PARTITION BY o_custkey")
_w("win_15_rows", "max(o_totalprice)", over=f"{_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING")
_w("win_16_range_offset", "count(*)", over="PARTITION BY o_custkey % 20 ORDER BY o_custkey RANGE BETWEEN 40 PRECEDING AND 20 FOLLOWING")
_w("win_18_short_form", "min(o_totalprice)", over=f"{_W} ROWS 5 PRECEDING")
_w("win_20_empty_frame", f"count(*) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS n, max(o_totalprice) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)")
_i("win_21_two_keys", "row_number()", "PARTITION BY o_custkey % 30, o_orderstatus ORDER BY o_orderkey")
sql_op("win_19_named", f"SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, count(*) OVER w AS n {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")


@op("win_22_before_order_by", f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS r {_O} ORDER BY o_orderkey DESC LIMIT 30")
def before_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window over all rows, ranked by ranges, then another order and a limit."""
    from sluice.operators import sorting

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sorting.global_row_number(o, ["o_totalprice", "o_orderkey"], "r").select("o_orderkey", "r").orderBy(F.desc("o_orderkey")).limit(30)


@op("win_13_lag_ignore_nulls", f"SELECT o_orderkey, lag(nullif(o_orderstatus, 'F'), 1 IGNORE NULLS) OVER ({_W}) AS v {_O}")
def lag_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("x", F.expr("nullif(o_orderstatus, 'F')"))
    return o.select("o_orderkey", windows.offset_ignoring_nulls("lag", "x", 1, ["o_custkey"], ["o_orderkey"]).alias("v"))


@op("win_17_groups", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n {_O}")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.col("o_custkey") % 20)
    return windows.groups_frame(o, ["p"], ["o_orderpriority"], -1, 0, n=(F.count, F.lit(1))).select("o_orderkey", "n")


@op("win_16_range", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderpriority RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v {_O}")
def range_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.col("o_custkey") % 20)
    return o.select("o_orderkey", F.count(F.lit(1)).over(windows.remaining(["p"], ["o_orderpriority"])).alias("v"))
