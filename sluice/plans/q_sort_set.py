"""Sorting, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import sorting
from sluice.plans import dialect
from sluice.plans.registry import op, sql_op
from sluice.sources.tables import register, table

@op("srt_01_order_by", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY seg ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS place FROM (SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)")
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order of mixed directions with nulls at either end, without a single task."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"))
    return sorting.global_row_number(c, [F.col("seg").asc_nulls_first(), F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").asc()], "place").select("c_custkey", "place")


sql_op("srt_02_unprojected", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_op("srt_03_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 10")
sql_op("srt_06_streaming_limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 7 OFFSET 2")
sql_op("srt_07_streaming_sort", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")


def _dialect(name: str, statement: str, oracle: str, names: list[str]) -> None:
    @op(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, names)
        return dialect.sql(spark, statement)


_dialect("srt_04_offset_fetch", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 5", ["part"])
_dialect("srt_05_top", "SELECT TOP (12) s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 12", ["supplier"])


@op("srt_08_top_k", "SELECT vec_id, round(CAST(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum') AS DOUBLE), 5) AS norm2 FROM embeddings ORDER BY list_extract(embedding, 1) DESC, vec_id LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.orderBy(F.col("embedding")[0].desc(), "vec_id").limit(10).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 5).alias("norm2"))


@op("srt_09_global_row_number", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS r FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.global_row_number(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "r").select("o_orderkey", "r")


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000"
sql_op("set_01_union_all", f"{_A} UNION ALL {_B}")
sql_op("set_02_union", f"{_A} UNION {_B}")
sql_op("set_03_except", f"{_A} EXCEPT {_B}")
sql_op("set_04_intersect", f"{_A} INTERSECT {_B}")
sql_op("set_05_nested", f"({_A} UNION {_B}) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_op("set_06_names_from_left", "SELECT r_name AS place FROM region UNION SELECT n_name FROM nation")
sql_op("set_07_nulls_equal", "SELECT nullif(o_orderstatus, 'F') AS s FROM orders INTERSECT SELECT nullif(o_orderstatus, 'F') FROM orders WHERE o_orderkey % 2 = 0")
sql_op("set_08_except_all", f"{_A} EXCEPT ALL {_B}")
sql_op("set_09_intersect_all", f"{_A} INTERSECT ALL {_B}")
