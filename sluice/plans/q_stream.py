"""Streams: lazy pipelines, the change feed and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.registry import op
from sluice.session import scratch
from sluice.sources.tables import table
from sluice.streaming import changefeed


@op("stm_01_lazy_pipeline", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def _changes(spark: SparkSession, sf_dir: str, of: str = "TRUE") -> DataFrame:
    e = table(spark, sf_dir, "events").where(of)
    kind = F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert")
    return e.select(F.col("event_id").alias("sequence"), kind.alias("operation"), F.col("user_id").alias("id"), F.col("props").alias("payload"), "ts")


_CHANGES = "SELECT event_id AS sequence, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'upsert' END AS operation, user_id AS id, props AS payload, ts FROM events"


@op("stm_04_stream_operators", "SELECT DISTINCT event_type FROM events WHERE value > 0.5")
def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, projection and distinct as a stream that runs over what is there and stops."""
    feed, at, e = scratch(spark), scratch(spark), table(spark, sf_dir, "events")
    e.select("event_type", "value").write.parquet(feed)
    s = spark.readStream.schema("event_type string, value double").parquet(feed).where("value > 0.5").select("event_type").dropDuplicates()
    s.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out", format="parquet").awaitTermination()
    return spark.read.schema("event_type string").parquet(f"{at}/out")


@op("stm_05_change_feed_replay", f"SELECT * FROM ({_CHANGES}) WHERE sequence > 100")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = scratch(spark)
    changefeed.append(_changes(spark, sf_dir, "event_id < 300"), feed)
    changefeed.append(_changes(spark, sf_dir, "event_id >= 300"), feed)
    return changefeed.replay(spark, feed, 100)


@op("stm_07_latest_state", f"""
SELECT sequence, operation, id, payload, ts FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1 AND operation <> 'delete'""")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, state, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for part in ("event_id < 200", "event_id >= 200"):
        changefeed.append(_changes(spark, sf_dir, part), feed)
        changefeed.materialise(spark, feed, state, checkpoint).awaitTermination()
    return changefeed.current(spark, state)


@op("stm_08_event_time_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))
