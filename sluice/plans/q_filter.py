"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import json_ops, scalar
from sluice.operators import subqueries
from sluice.plans import dialect
from sluice.plans.registry import op, sql_op
from sluice.sources.tables import register, table

sql_op("prj_01_columns_aliases", "SELECT c.c_custkey AS id, c.c_name AS name FROM customer AS c")
sql_op("prj_02_computed", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS kind FROM lineitem")
sql_op("prj_04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql_op("prj_05_no_from", "SELECT 1 AS one, 'x' AS x")
sql_op("flt_01_comparisons", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10 OR (l_quantity <> 11 AND l_quantity < 3) OR l_quantity >= 50")
sql_op("flt_02_and_or_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderpriority <> '1-URGENT'")
sql_op("flt_03_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_orderkey NOT BETWEEN 1000 AND 2000")
sql_op("flt_04_is_null", "SELECT o_orderkey, x IS NULL AS is_n, x IS NOT NULL AS not_n FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS x FROM orders)")
sql_op("flt_05_distinct_from", "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS a, nullif(o_orderstatus, 'O') AS b FROM orders) WHERE a IS DISTINCT FROM b AND NOT (a IS NOT DISTINCT FROM 'P')")
sql_op("flt_06_in_list", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 7) OR (n_regionkey NOT IN (0, 1, 2) AND n_nationkey > 10)")
sql_op("flt_07_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql_op("flt_08_exists", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 3) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 99)")
sql_op("flt_09_correlated_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_op("flt_11_like_prefix", "SELECT c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
sql_op("flt_12_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O_Y' OR p_name LIKE '%e_ %g%'")
sql_op("flt_13_truthy", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 250000 AS flag FROM orders) WHERE flag")
sql_op("flt_14_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(c_acctbal) * 40 FROM customer)")
sql_op("flt_15_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
sql_op("flt_16_case", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' END AS band FROM supplier")
sql_op("flt_17_cast", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(CAST(o_orderkey AS VARCHAR(20)) AS BIGINT) AS b FROM orders",
       "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b FROM orders")
sql_op("flt_18_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_linenumber AS s, l_quantity * 3 AS m, l_quantity % 7 AS r, -l_linenumber AS neg, l_returnflag || '-' || l_linestatus AS cat FROM lineitem")
sql_op("flt_19_typed_literals", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1995-06-30' AND TRUE",
       "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1995-06-30' AND TRUE")
sql_op("flt_20_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING (count(*) > 12 OR max(o_totalprice) > 400000) AND NOT (o_custkey < 10)")
sql_op("flt_21_coercion", "SELECT count(*) AS n FROM orders WHERE o_orderkey = CAST('17' AS BIGINT) OR o_totalprice > CAST(300000 AS BIGINT)")


@op("prj_03_json_projection", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_ops.typed("props", "k", "bigint").alias("k"))


@op("flt_10_any_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 30 FROM customer WHERE c_nationkey = 3) AND o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = subqueries.compare_all(table(spark, sf_dir, "orders"), "o_totalprice", ">", c.where("c_nationkey = 3").select((F.col("c_acctbal") * 30).alias("x")), "x")
    return subqueries.compare_any(o, "o_custkey", "=", c.where("c_acctbal > 5000"), "c_custkey").select("o_orderkey")


@op("flt_10_any_all_sql", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 20) OR s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 5)")
def any_all_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["supplier", "customer"])
    return dialect.sql(spark, "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 20) OR s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 5)")


@op("flt_11_like_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
def like_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(scalar.like_ci("c_mktsegment", "build%")).select("c_custkey")


@op("flt_18_division", "SELECT l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_linenumber - 1, 0) AS q FROM lineitem")
def division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.divide("l_extendedprice", F.col("l_linenumber") - 1).alias("q"))


@op("flt_22_collate", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.collate("c_mktsegment", "UTF8_LCASE") == "machinery").select("c_custkey")
