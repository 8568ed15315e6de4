"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import stats
from sluice.plans.registry import op, sql_op
from sluice.sources.tables import table

_M = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
sql_op("agg_01_group_by", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_M.format('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_op("agg_02_count_star", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql_op("agg_03_count_column", "SELECT o_orderpriority, count(nullif(o_orderstatus, 'F')) AS n FROM orders GROUP BY o_orderpriority")
sql_op("agg_04_sum", f"SELECT c_nationkey, {_M.format('c_acctbal')} AS total, sum(nullif(c_custkey, c_custkey)) AS none FROM customer GROUP BY c_nationkey",
       f"SELECT c_nationkey, {_M.format('c_acctbal')} AS total, CAST(sum(nullif(c_custkey, c_custkey)) AS BIGINT) AS none FROM customer GROUP BY c_nationkey")
sql_op("agg_05_avg", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_nationkey")
sql_op("agg_06_min", "SELECT o_orderpriority, min(o_totalprice) AS lo, min(o_orderdate) AS first FROM orders GROUP BY o_orderpriority")
sql_op("agg_07_max", "SELECT o_orderpriority, max(o_totalprice) AS hi, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority")
sql_op("agg_08_global", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
sql_op("agg_09_where_before", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey")
sql_op("agg_10_null_key", "SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')")
sql_op("agg_12_paged", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 3")
sql_op("agg_13_streaming_twin", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
sql_op("agg_14_over_join", "SELECT o_orderstatus, CAST(sum(d.n) AS BIGINT) AS n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) d ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
sql_op("agg_15_payload_count", "SELECT count(*) AS n FROM embeddings WHERE label = 3")
sql_op("agg_18_distinct_rollup", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_op("agg_19_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")


@op("agg_11_case_insensitive", "SELECT lower(k) AS k, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS k FROM customer) GROUP BY lower(k)")
def ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    g = table(spark, sf_dir, "customer").select(F.collate(k, "UTF8_LCASE").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return g.select(F.lower(F.collate("k", "UTF8_BINARY")).alias("k"), "n")


@op("agg_16_corpus_statistics", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT doc_id) > 20""")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.operators import fulltext

    return fulltext.term_statistics(fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text")).where("df > 20")


@op("agg_17_column_statistics", "SELECT count(*) AS n_rows, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction, count(DISTINCT x) AS distinct_values, min(x) AS lo, max(x) AS hi FROM (SELECT nullif(o_orderstatus, 'P') AS x FROM orders)")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("x"))
    return stats.summary(df, "x", exact=True)


@op("agg_17_most_common_values", "SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, value LIMIT 32")
def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common(table(spark, sf_dir, "customer"), "c_nationkey")


@op("agg_17_histogram", "SELECT bucket, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT o_totalprice AS v, ntile(64) OVER (ORDER BY o_totalprice, o_orderkey) AS bucket FROM orders) GROUP BY bucket")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.equi_depth(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")
