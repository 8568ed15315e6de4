"""The change feed of a collection: appended change files, replay after a sequence, live tail, and latest state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "sequence bigint, operation string, id bigint, payload string, ts timestamp_ntz"


def append(changes: DataFrame, feed: str) -> None:
    """Adds changes (the columns of SCHEMA) to the feed."""
    changes.select("sequence", "operation", "id", "payload", "ts").write.mode("append").parquet(feed)


def replay(spark: SparkSession, feed: str, after: int = -1) -> DataFrame:
    """Changes with a greater sequence, in order."""
    return spark.read.schema(SCHEMA).parquet(feed).where(F.col("sequence") > after).orderBy("sequence")


def tail(spark: SparkSession, feed: str, after: int = -1, files_per_trigger: int = 100) -> DataFrame:
    """The feed as a stream; a query's checkpoint resumes where it stopped."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(feed).where(F.col("sequence") > after)


def messages(changes: DataFrame, data: list[str]) -> DataFrame:
    """Changes as server-sent events: id, event and the named columns as JSON."""
    return changes.select(F.format_string("id: %s\nevent: %s\ndata: %s\n\n", F.col("sequence").cast("string"), "operation", F.to_json(F.struct(*data))).alias("message"))


def _last(changes: DataFrame) -> DataFrame:
    rest = F.struct("sequence", "operation", "payload", "ts")
    return changes.groupBy("id").agg(F.max_by(rest, "sequence").alias("r")).select("r.sequence", "r.operation", "id", "r.payload", "r.ts")


def materialise(spark: SparkSession, feed: str, state: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the last change of each id under ``state``/<batch>: each micro-batch is merged with the version before it.

    A batch that runs again writes the same version again, so the state is right after a failure.
    """

    def merge(batch: DataFrame, n: int) -> None:
        before = [v for v in versions(spark, state) if v < n]
        changes = batch.select("sequence", "operation", "id", "payload", "ts")
        if before:
            changes = changes.unionByName(spark.read.schema(SCHEMA).parquet(f"{state}/{max(before)}"))
        _last(changes).write.mode("overwrite").parquet(f"{state}/{n}")
        for v in before[:-1]:  # the one before stays for those who read it
            _delete(spark, f"{state}/{v}")
        if on_batch:
            on_batch(batch, n)

    return tail(spark, feed).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def versions(spark: SparkSession, state: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())


def current(spark: SparkSession, state: str) -> DataFrame:
    """Rows of the latest version that are not deleted."""
    return spark.read.schema(SCHEMA).parquet(f"{state}/{versions(spark, state)[-1]}").where("operation <> 'delete'")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling counts by event time, with a watermark when the input is a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
