"""Imports where executors are processes of their own."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

from sluice.sources import files

RUN = """
import sys
from pyspark.sql import SparkSession
from sluice.plans.registry import load
spark = SparkSession.builder.master("local-cluster[2,1,700]").config("spark.executor.memory", "500m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
got = load()["src_20_jdbc_import"].query(spark, sys.argv[1])
print("READ", got.count(), got.agg({"o_orderkey": "sum"}).first()[0], got.rdd.getNumPartitions())
"""


def test_jdbc_import_reaches_all_executors(spark, sf, tmp_path):
    (tmp_path / "work").mkdir()  # executors work in Spark's home
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (tmp_path / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_HOME": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).parents[1])}
    out = subprocess.run([sys.executable, "-c", RUN, sf], env=env, capture_output=True, text=True, timeout=180)
    want = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 400").selectExpr("count(*)", "sum(o_orderkey)").first()
    assert f"READ {want[0]} {want[1]} 4" in out.stdout, out.stderr[-2000:]


def test_packed_table_keeps_nulls_and_may_be_empty(spark):
    for rows in ([(1, 0.5), (-7, None), (2**40, 1e300)], []):
        url, driver = files.pack_derby(spark, "t", 'CREATE TABLE t ("k" BIGINT, "v" DOUBLE)', rows)
        got = files.import_jdbc(spark, url, "t", "k", (0, 10), 2, driver=driver)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
