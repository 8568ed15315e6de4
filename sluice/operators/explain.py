"""EXPLAIN as rows: the nodes of a physical plan, outermost first."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_rows(df: DataFrame) -> DataFrame:
    """(depth, operation, details) of the plan that Spark has chosen before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    rows = []
    for line in text.split("\n"):
        if m := re.match(r"([\s:+\-|*()\d]*?)([A-Z]\w+)(.*)", line):
            rows.append((len(m[1]), m[2], m[3].strip()[:500]))
    return df.sparkSession.createDataFrame(rows, "depth int, operation string, details string")
