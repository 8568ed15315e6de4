"""Catalog views: what tables and columns the session knows, as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables: name, kind and whether temporary."""
    rows = [(t.catalog or "", (t.namespace or [""])[0], t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string, is_temporary boolean")


def columns(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """information_schema.columns of the named tables (all that are known if None)."""
    names = names or [t.name for t in spark.catalog.listTables()]
    rows = [(n, f.name, i + 1, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(spark.table(n).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")


def views(spark: SparkSession) -> DataFrame:
    """information_schema.views: tables that are views, temporary ones included."""
    return tables(spark).where("table_type IN ('VIEW', 'TEMPORARY')")


def schemata(spark: SparkSession) -> DataFrame:
    """information_schema.schemata: the databases of the current catalog."""
    rows = [(d.catalog or "", d.name, d.description or "") for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "catalog_name string, schema_name string, comment string")


def routines(spark: SparkSession) -> DataFrame:
    """information_schema.routines: functions, built in and user-defined."""
    rows = [(f.name, f.description or "", bool(f.isTemporary)) for f in spark.catalog.listFunctions()]
    return spark.createDataFrame(rows, "routine_name string, comment string, is_temporary boolean")


def parameters(spark: SparkSession, names: list[str]) -> DataFrame:
    """information_schema.parameters of the named SQL functions, from what the catalog keeps of them."""
    rows = []
    for f in spark.catalog.listFunctions():
        if f.name in names and (f.description or "").startswith("{"):
            given = json.loads(f.description).get("sqlFunction.inputParam") or ""
            rows += [(f.name, p.name, p.dataType.simpleString(), i) for i, p in enumerate(StructType.fromDDL(given) if given else [], 1)]
    return spark.createDataFrame(rows, "routine_name string, parameter_name string, data_type string, ordinal_position int")
