"""Data modification and definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import dml, explain, schema
from sluice.plans.registry import op
from sluice.sources.tables import register, table

_C = "c_custkey, c_name, c_nationkey"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


def _source(c: DataFrame) -> DataFrame:
    """Half known keys, half new ones."""
    known = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("updated").alias("c_name"), F.lit(99).alias("c_nationkey"))
    return known.union(c.where("c_custkey % 10 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.col("c_nationkey")))


_NEW = f"SELECT c_custkey + 1000000 AS c_custkey, 'new' AS c_name, c_nationkey FROM customer WHERE c_custkey % 10 = 1"


@op("dml_01_update", f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_name END AS c_name, c_nationkey FROM customer")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(_customers(spark, sf_dir), F.col("c_nationkey") == 3, c_name="moved")


@op("dml_02_delete", f"SELECT {_C} FROM customer WHERE NOT coalesce(nullif(c_nationkey, 5) < 10, FALSE)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(_customers(spark, sf_dir), F.expr("nullif(c_nationkey, 5) < 10"))


@op("dml_03_on_conflict_do_nothing", f"SELECT {_C} FROM customer UNION ALL {_NEW}")
def do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return dml.insert_ignore(c, _source(c), ["c_custkey"])


@op("dml_04_on_conflict_do_update", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 20 THEN 'updated' ELSE c_name END AS c_name, c_nationkey FROM customer UNION ALL {_NEW}")
def do_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return dml.upsert(c, _source(c), ["c_custkey"], {"c_name": F.col("excluded.c_name")}, F.col("t.c_nationkey") < 20)


@op("dml_05_merge", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer UNION ALL {_NEW}")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return dml.merge(c, _source(c), ["c_custkey"], {"c_name": F.col("s.c_name"), "c_nationkey": F.col("s.c_nationkey")})


@op("dml_06_truncate", "SELECT * FROM region WHERE FALSE")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.truncate(table(spark, sf_dir, "region"))


@op("dml_07a_foreign_key_check", "SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_custkey % 2000 * 3, 9) AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer)")
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_custkey % 2000 * 3, 9)").alias("k"))
    return dml.orphans(o, table(spark, sf_dir, "customer"), {"k": "c_custkey"})


@op("dml_07b_on_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return dml.delete_parent(table(spark, sf_dir, "customer"), F.col("c_nationkey") < 5, [(o, {"o_custkey": "c_custkey"}, "CASCADE")])[1][0]


@op("dml_07b_on_delete_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return dml.delete_parent(table(spark, sf_dir, "customer"), F.col("c_nationkey") < 5, [(o, {"o_custkey": "c_custkey"}, "SET NULL")])[1][0]


@op("dml_07c_on_update_cascade", "SELECT n_nationkey, CASE WHEN n_regionkey >= 3 THEN n_regionkey + 100 ELSE n_regionkey END AS n_regionkey FROM nation")
def update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "region").where("r_regionkey >= 3").select("r_regionkey", (F.col("r_regionkey") + 100).alias("now"))
    return dml.cascade_key_update(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), moved, "n_regionkey", "r_regionkey", "now")


@op("dml_08_unique_check", "SELECT k, count(*) AS n FROM (SELECT c_custkey % 1000 AS k FROM customer) GROUP BY k HAVING count(*) > 1")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.duplicates(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("k")), ["k"])


@op("dml_09_check_constraint", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.check_violations(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.expr("nullif(s_acctbal, 0) >= 0"))


@op("ddl_01_create_table", "SELECT 1 AS id, 'a' AS name WHERE FALSE")
def create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.Table("t", {"id": "INT", "name": "VARCHAR(20)"}, ["id"], checks={"named": "length(name) > 0"}).empty(spark)


@op("ddl_02_drop_table", "SELECT 0::BIGINT AS n")
def drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.range(1).createOrReplaceTempView("to_drop")
    spark.catalog.dropTempView("to_drop")
    return spark.createDataFrame([(sum(t.name == "to_drop" for t in spark.catalog.listTables()),)], "n bigint")


@op("ddl_03_add_column", "SELECT r_regionkey, r_name, 7 AS extra FROM region")
def add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.add_column(table(spark, sf_dir, "region"), "extra", "INT", 7)


@op("ddl_04_drop_column", "SELECT n_nationkey, n_name FROM nation")
def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.drop_column(table(spark, sf_dir, "nation"), "n_regionkey")


@op("ddl_05_alter_type", "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.alter_type(table(spark, sf_dir, "nation"), "n_regionkey", "BIGINT")


@op("ddl_06_rename", "SELECT r_regionkey AS id, r_name FROM region")
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.rename_column(table(spark, sf_dir, "region"), "r_regionkey", "id")


@op("ddl_07_add_constraint", "SELECT n_nationkey FROM nation WHERE n_regionkey * 2 NOT IN (SELECT r_regionkey FROM region)")
def add_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("twice", F.col("n_regionkey") * 2)
    t = schema.Table("nation", {}, foreign_keys={"fk": ({"twice": "r_regionkey"}, "region")})
    return t.violations(n, {"region": table(spark, sf_dir, "region")})["23503 fk"].select("n_nationkey")


@op("ddl_09_analyze", "SELECT count(*) AS n_rows, 0.0::DOUBLE AS null_fraction, count(DISTINCT c_nationkey) AS distinct_values, min(c_nationkey) AS lo, max(c_nationkey) AS hi FROM customer")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.operators import stats

    return stats.summary(table(spark, sf_dir, "customer"), "c_nationkey", exact=True)


@op("ddl_10_explain", "SELECT * FROM (VALUES ('Exchange', FALSE), ('FileScan', TRUE), ('Filter', FALSE), ('HashAggregate', FALSE)) v(operation, is_scan)")
def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of a plan, and that its scan has the filter pushed down."""
    register(spark, sf_dir, ["orders"])
    rows = explain.plan_rows(spark.sql("SELECT o_custkey, count(*) FROM orders WHERE o_orderkey > 5 GROUP BY o_custkey"))
    pushed = F.col("details").contains("GreaterThan(o_orderkey,5)")
    return rows.where(F.col("operation").isin("Exchange", "FileScan", "Filter", "HashAggregate")).groupBy("operation").agg(F.bool_or(pushed).alias("is_scan"))
