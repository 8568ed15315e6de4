"""Functions, procedures, scripts and eager loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import eager, procs
from sluice.plans import dialect
from sluice.plans.registry import op
from sluice.sources.tables import register, table


@op("udf_01_sql_function", "SELECT o_orderkey, round(o_totalprice * 1.19 + 1, 4) AS gross FROM orders WHERE round(o_totalprice * 1.19 + 1, 4) > 300000")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders"])
    procs.create_function(spark, "gross", {"x": "DOUBLE"}, "DOUBLE", "round(x * 1.19D + 1, 4)")
    return spark.sql("SELECT o_orderkey, gross(o_totalprice) AS gross FROM orders WHERE gross(o_totalprice) > 300000")


@op("udf_04_rows_from_procedure", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = procs.Procedures(spark)
    p.create("customers_of", lambda s, nation: table(s, sf_dir, "customer").where(F.col("c_nationkey") == nation).select("c_custkey", "c_name"))
    return p.call("customers_of", nation=4)


@op("prc_01_overloads", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), procs.Procedures(spark)
    p.create("summary", lambda s, status: o.where(F.col("o_orderstatus") == status))
    p.create("summary", lambda s, status, least: o.where((F.col("o_orderstatus") == status) & (F.col("o_totalprice") > least)).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")))
    return p.call("summary", "O", 1000)


@op("prc_02_call_out_values", "SELECT count(*) AS n FROM region")
def call(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = procs.Procedures(spark)
    p.create("count_regions", lambda s: {"n": table(s, sf_dir, "region").count()})
    return spark.createDataFrame([(p.call("count_regions")["n"],)], "n bigint")


_SCRIPT = """
BEGIN
  DECLARE total BIGINT DEFAULT 0;
  DECLARE i BIGINT DEFAULT 1;
  WHILE i <= 10 DO
    IF i % 2 = 0 THEN SET total = total + i * i; END IF;
    SET i = i + 1;
  END WHILE;
  SELECT total AS total;
END
"""


@op("prc_04_script_while", "SELECT CAST(sum(i * i) AS BIGINT) AS total FROM range(1, 11) t(i) WHERE i % 2 = 0")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SCRIPT)


@op("prc_04a_for_query", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_regionkey = 1")
def for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation"])
    return spark.sql("BEGIN DECLARE t BIGINT DEFAULT 0; FOR r AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) DO SET t = t + r.n_nationkey; END FOR; SELECT t AS total; END")


@op("prc_04b_forall", "SELECT i, i * i AS square FROM range(3, 21) t(i)")
def forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procs.for_each(spark, 3, 20).select("i", (F.col("i") * F.col("i")).alias("square"))


@op("prc_04c_select_into", "SELECT r_name FROM region WHERE r_regionkey = 2")
def into(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = procs.select_into(table(spark, sf_dir, "region").where("r_regionkey = 2"), strict=True)
    return spark.createDataFrame([(row["r_name"],)], "r_name string")


@op("prc_04d_exception_handler", "SELECT 'handled' AS outcome")
def handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SELECT 'handled' AS outcome; END; SELECT CAST(1/0 AS STRING) AS outcome; END")


@op("prc_06_trigger_transition_tables", "SELECT count(*) AS n FROM supplier WHERE s_acctbal < 0")
def trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, seen = procs.Triggers(), []
    t.on("AFTER", "DELETE", lambda inserted, deleted: seen.append(deleted.agg(F.count("*").alias("n"))))
    s = table(spark, sf_dir, "supplier")
    t.run("DELETE", s, s.limit(0), s.where("s_acctbal < 0"), lambda target, ins, dele: target.where("s_acctbal >= 0"))
    return seen[0]


@op("prc_07_cursor", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame(procs.Cursor(n.orderBy("n_nationkey")).open().fetch(5), n.schema)


@op("prc_08_prepared_bind", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
def bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders"])
    return dialect.sql(spark, "SELECT o_orderkey FROM orders WHERE o_orderstatus = @s AND o_totalprice > @least", s="P", least=150000)


@op("prc_09_script_splitter", "SELECT * FROM (VALUES (1, 'SELECT 1'), (2, 'SELECT '';'' AS x'), (3, 'BEGIN SELECT 2; END')) v(i, statement)")
def splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dialect.split("SELECT 1; SELECT ';' AS x; -- done;\nBEGIN SELECT 2; END;")
    return spark.createDataFrame(list(enumerate(parts, 1)), "i int, statement string")


@op("lnq_01_fluent_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(o.o_orderstatus == "O").orderBy(o.o_totalprice.desc(), o.o_orderkey).offset(20).limit(10).select("o_orderkey", "o_totalprice")


@op("lnq_02_include", "SELECT c_custkey, coalesce((SELECT list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') x WHERE x.o_custkey = c.c_custkey AND r <= 3), []) AS top_orders FROM customer c")
def include(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    got = eager.include(table(spark, sf_dir, "customer"), o, "c_custkey", "o_custkey", "orders", F.col("o_orderstatus") == "F", [F.col("o_totalprice").desc(), "o_orderkey"], take=3)
    return got.select("c_custkey", F.col("orders.o_orderkey").alias("top_orders"))
