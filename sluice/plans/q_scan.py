"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import json_ops
from sluice.operators import recursive
from sluice.plans.registry import op, sql_op
from sluice.session import scratch
from sluice.sources import catalog, files
from sluice.sources.tables import register, table

sql_op("src_01_scan_filter", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
sql_op("src_02_predicate_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.09 AND l_tax < 0.02")
sql_op("src_03_pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
sql_op("src_04_pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
sql_op("src_05_index_range", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 4 AND c_nationkey <= 8")
sql_op("src_10_count", "SELECT count(*) AS n FROM lineitem")
sql_op("src_11_derived_table", "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE d.n > 3")
sql_op("src_12_ctes", """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000),
     n AS (SELECT o_custkey, count(*) AS n_big FROM big GROUP BY o_custkey)
SELECT c_name, n_big FROM n JOIN customer ON c_custkey = o_custkey""")
sql_op("src_13_recursive_union_all", "WITH RECURSIVE s(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM s WHERE n < 40) SELECT n, f FROM s")
sql_op("src_21_vector_scan", "SELECT vec_id, label FROM embeddings WHERE label IS NOT NULL")


@op("src_06_index_lookup", "SELECT event_id FROM events WHERE (props->>'$.k') = '7'")
def gin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(json_ops.contains_json("props", '{"k": 7}') & json_ops.has_key("props", "k")).select("event_id")


@op("src_07_index_tokens", "SELECT event_id, unnest(['k', 'k=' || (props->>'$.k')]) AS token FROM events WHERE (props->>'$.k') IS NOT NULL")
def gin_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(json_ops.index_tokens("props")).alias("token"))


@op("src_08_streamed_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that ``files.stream_rows`` hands out as they come; a unit test holds it to them."""
    return table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name")


@op("src_09_prepared_point_query", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 33")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders"])
    return spark.sql("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = :id", args={"id": 33})


@op("src_13_recursive_union", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 50 AS src, (o_custkey * 7 + 3) % 50 AS dst FROM orders),
r(src, dst) AS (SELECT src, dst FROM e WHERE src < 5 UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src, dst FROM r""")
def recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("src"), ((F.col("o_custkey") * 7 + 3) % 50).alias("dst")).distinct()
    step = lambda r: r.alias("r").join(e.alias("e"), F.col("r.dst") == F.col("e.src")).select("r.src", "e.dst")
    return recursive.fixpoint(e.where("src < 5"), step)


@op("src_14_view", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").where("c_acctbal > 0").createOrReplaceTempView("solvent_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM solvent_customer GROUP BY c_mktsegment")


@op("src_15_information_schema_columns", "SELECT table_name, column_name, ordinal_position, CASE WHEN data_type LIKE '%INT%' THEN 'int' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END AS kind FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'events')")
def info_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation", "region", "events"])
    kind = F.when(F.col("data_type").contains("int"), "int").when(F.col("data_type") == "string", "text").otherwise("other")
    return catalog.columns(spark, ["nation", "region", "events"]).select("table_name", "column_name", "ordinal_position", kind.alias("kind"))


@op("src_16_catalog_tables", "SELECT table_name FROM information_schema.tables WHERE table_name IN ('nation', 'region', 'orders')")
def info_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation", "region", "orders"])
    return catalog.tables(spark).where(F.col("table_name").isin("nation", "region", "orders")).select("table_name")


@op("src_16_views", "SELECT table_name FROM information_schema.tables WHERE table_name IN ('nation', 'region')")
def info_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation", "region"])
    return catalog.views(spark).where(F.col("table_name").isin("nation", "region")).select("table_name")


@op("src_16_schemata", "SELECT 'default' AS schema_name")
def info_schemata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schemata(spark).where("schema_name = 'default'").select("schema_name")


@op("src_16_routines", "SELECT * FROM (VALUES ('net', 'p', 'double', 1), ('net', 'rate', 'double', 2)) v(routine_name, parameter_name, data_type, ordinal_position)")
def info_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.operators import procs

    procs.create_function(spark, "net", {"p": "DOUBLE", "rate": "DOUBLE"}, "DOUBLE", "p / (1 + rate)")
    known = catalog.routines(spark).where("routine_name = 'net' AND is_temporary").select("routine_name")
    return known.join(catalog.parameters(spark, ["net"]), "routine_name")


@op("src_17_describe", "SELECT column_name AS col_name FROM information_schema.columns WHERE table_name = 'orders'")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders"])
    return spark.sql("DESCRIBE TABLE orders").select("col_name")


@op("src_18_copy_from", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = table(spark, sf_dir, "nation"), scratch(spark)
    files.copy_to(n, at, delimiter="|", header=True, null="\\N")
    return files.copy_from(spark, at, n.schema, delimiter="|", header=True, null="\\N")


@op("src_22_snapshot", "SELECT r_regionkey, r_name FROM region")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    files.backup(table(spark, sf_dir, "region"), at)
    return spark.read.parquet(at)


@op("snk_01_copy_to_csv", "SELECT c_custkey, c_name FROM customer")
def copy_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, at = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch(spark)
    files.copy_to(df, at, delimiter=",", header=False)
    return files.copy_from(spark, at, df.schema, delimiter=",", header=False)


@op("snk_02_insert_values", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'NEW'), (101, NULL)) v(a, b)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.union(spark.createDataFrame([(100, "NEW"), (101, None)], r.schema))


@op("snk_03_insert_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_regionkey = 1")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name"), scratch(spark)
    files.append(n, at)
    files.append(n.withColumn("n_nationkey", F.col("n_nationkey") + 1000), at)
    return spark.read.parquet(at)


@op("snk_04_bulk_copy", "SELECT p_partkey, p_name FROM part")
def bulk_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    files.append(table(spark, sf_dir, "part").select("p_partkey", "p_name"), at)
    return spark.read.parquet(at)


@op("snk_05_insert_batch", "SELECT CAST(i AS BIGINT) AS id, 'row ' || i AS name FROM range(50) t(i)")
def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, f"row {i}") for i in range(50)], "id bigint, name string")


@op("snk_07_backup", "SELECT * FROM supplier")
def backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    files.backup(table(spark, sf_dir, "supplier"), at)
    return spark.read.parquet(at)
