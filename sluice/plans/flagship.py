"""The flagship query: revenue by region and year over a five-way star join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.registry import op
from sluice.sources.tables import table

SQL = """
SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(count(*) AS BIGINT) AS n_lines,
       round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1993-01-01 00:00:00'
GROUP BY ALL HAVING count(*) > 10
"""


@op("flagship_revenue_by_region", SQL)
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").where(F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp_ntz"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", F.year("o_orderdate").cast("bigint").alias("order_year"))
        .agg(F.count("*").alias("n_lines"),
             F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double"), 2).alias("revenue"))
        .where("n_lines > 10")
    )
