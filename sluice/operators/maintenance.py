"""Layout advice in place of index statements, compaction in place of VACUUM, and which plans can run as streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def create_index(spark: SparkSession, statement: str) -> dict[str, str]:
    """CREATE [UNIQUE] INDEX as what it means for files: columns to sort by, or a text or payload index to build; nothing is changed."""
    m = re.match(r"\s*create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(\w+)\s+on\s+(\w+)\s*(?:using\s+(\w+)\s*)?\(([^)]*)\)\s*(?:using\s+(\w+))?\s*;?\s*$", statement, re.I)
    if not m:
        raise ValueError(f"not an index statement: {statement}")
    kind = (m[4] or m[6] or "btree").lower()
    columns = [c.strip().split()[0] for c in m[5].split(",")]
    return {"name": m[2], "table": m[3], "kind": kind, "columns": ",".join(columns), "unique": str(bool(m[1])).lower(),
            "advice": "inverted index" if kind == "gin" else f"sort by {', '.join(columns)}"}


def vacuum(spark: SparkSession, path: str, to: str, rows_a_file: int = 1_000_000, sort: list[str] | None = None) -> DataFrame:
    """The table written again into few files, sorted for pruning if asked; the old files stay until the caller drops them."""
    df = spark.read.parquet(path)
    files = max(1, -(-df.count() // rows_a_file))
    out = df.repartitionByRange(files, *sort).sortWithinPartitions(*sort) if sort else df.repartition(files)
    out.write.parquet(to)
    return spark.read.parquet(to)


#: What keeps a plan from being read lazily: nodes of the optimized plan, by the name that the report gives them.
_BLOCKERS = {"window function": r"^\W*Window", "right join": r"^\W*Join (RightOuter|FullOuter)", "sort of an aggregate": r"^\W*Sort[\s\S]*?Aggregate", "aggregate of a join": r"^\W*Aggregate[\s\S]*?Join"}


def blockers(df: DataFrame) -> list[str]:
    """Why a query's rows can't be handed out as they are found; empty if they can."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [name for name, pattern in _BLOCKERS.items() if re.search(pattern, plan, re.M)]
