"""Session construction. On a cluster the submitter's settings win; these are defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use '__' for '.'."""
    b = SparkSession.builder.appName("sluice")
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A fresh folder name in the cluster's shared folder (spark.checkpoint.dir); a local one only where that is unset and all runs on one machine."""
    import re
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = at or tempfile.mkdtemp(prefix="sluice-")
    return f"{at.rstrip('/')}/sluice-{uuid.uuid4().hex}"
