"""Joins. Strategies are Spark's to choose; hints only show that each gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.registry import op, sql_op
from sluice.sources.tables import table

_CO = "SELECT c_custkey, c_name, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"
sql_op("jon_01_inner", _CO.format("INNER"))
sql_op("jon_02_left", _CO.format("LEFT"))
sql_op("jon_03_right", "SELECT o_orderkey, n_name FROM nation RIGHT JOIN (SELECT o_orderkey, o_custkey % 40 AS k FROM orders) o ON n_nationkey = k")
sql_op("jon_04_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_nationkey")
sql_op("jon_05_using", "SELECT k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY c_custkey) b USING (k)")
sql_op("jon_06_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey UNION ALL SELECT r_name, n_name FROM region JOIN nation ON r_regionkey > n_nationkey")
sql_op("jon_07_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_op("jon_08_multiway", "SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000")
sql_op("jon_14_streaming_nested_loop", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
sql_op("jon_16_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql_op("jon_17_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sql_op("jon_17_not_in_nulls", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 7) FROM nation WHERE n_nationkey < 8)")
sql_op("jon_19_sorted_page", "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
sql_op("jon_20_full_outer", "SELECT coalesce(s_nationkey, k) AS nation, s_suppkey, k FROM supplier FULL JOIN (SELECT n_nationkey * 2 AS k FROM nation) x ON s_nationkey = k")


def _hinted(name: str, hint: str) -> None:
    @op(name, "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part").where("p_size < 5").hint(hint)
        return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


_hinted("jon_09_hash", "SHUFFLE_HASH")
_hinted("jon_10_sort_merge", "MERGE")
_hinted("jon_12_index_lookup_broadcast", "BROADCAST")
sql_op("jon_11_nested_loop", "SELECT o_orderkey, r_name FROM orders JOIN region ON o_orderkey % 7 > r_regionkey")
sql_op("jon_13_range_pruned", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey BETWEEN 500 AND 900")


@op("jon_15_key_coercion", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE lower(c_mktsegment) = 'building'")
def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of different types meet by explicit casts; strings without regard to case by collation."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "region").limit(1).select(F.lit("building").alias("seg")), F.collate("c_mktsegment", "UTF8_LCASE") == F.collate("seg", "UTF8_LCASE"))
    return c.join(o, c["c_custkey"] == o["k"].cast("bigint")).select("c_custkey", "o_orderkey")


@op("jon_18_strategy_report", "SELECT * FROM (VALUES ('broadcast', 'BroadcastHashJoin'), ('merge', 'SortMergeJoin'), ('shuffle_hash', 'ShuffledHashJoin')) v(hint, strategy)")
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join that is planned, as EXPLAIN tells it, for each hint."""
    from functools import reduce

    from sluice.operators.explain import plan_rows

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    plans = [plan_rows(o.join(c.hint(h), F.col("o_custkey") == F.col("c_custkey"))).where("operation LIKE '%Join'").select(F.lit(h).alias("hint"), F.col("operation").alias("strategy")) for h in ("broadcast", "merge", "shuffle_hash")]
    return reduce(DataFrame.union, plans)
