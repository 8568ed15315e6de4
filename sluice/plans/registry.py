"""The operator registry: each entry pairs a Spark query with its oracle SQL (or None)."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.tables import TABLES, register

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Op:
    name: str
    query: Query
    sql: str | None


OPS: dict[str, Op] = {}

#: Modules that register operators when imported.
MODULES = ("flagship", "q_scan", "q_filter", "q_join", "q_agg", "q_window", "q_sort_set", "q_scalar",
           "q_json", "q_dml", "q_proc", "q_search", "q_stream", "q_more")


def op(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn: Query) -> Query:
        if name in OPS:
            raise ValueError(f"operator {name} is registered twice")
        OPS[name] = Op(name, fn, sql)
        return fn

    return add


def sql_op(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query given as Spark SQL over the tables it names; ``oracle`` where the other dialect differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", sql)])
        return spark.sql(sql)

    run.__name__ = name
    op(name, oracle or sql)(run)


def load() -> dict[str, Op]:
    """All operators, in registration order."""
    for m in MODULES:
        importlib.import_module(f"sluice.plans.{m}")
    return OPS
