"""Table definitions with constraints, and ALTER TABLE as transformations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import dml

TYPES = {
    "SMALLINT": "smallint", "INT16": "smallint", "INT": "int", "INT32": "int", "INTEGER": "int", "BIGINT": "bigint", "INT64": "bigint", "LONG": "bigint",
    "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "DECIMAL": "decimal(38,18)", "NUMERIC": "decimal(38,18)", "MONEY": "decimal(38,18)",
    "BIT": "boolean", "BOOL": "boolean", "BOOLEAN": "boolean", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
    "DATE": "date", "TIME": "time(6)", "VARBINARY": "binary", "BINARY": "binary", "BLOB": "binary", "BYTEA": "binary", "JSON": "string",
    "UNIQUEIDENTIFIER": "string", "UUID": "string", "GUID": "string",
}


def spark_type(name: str) -> str:
    """A declared type as Spark's; lengths are ignored, a decimal keeps its digits, anything unknown is a string."""
    head, _, rest = name.strip().upper().partition("(")
    if head in ("DECIMAL", "NUMERIC") and rest:
        return f"decimal({rest}"
    return TYPES.get(head, "string")


@dataclass
class Table:
    """Columns and constraints; ``violations`` says what a state of the table breaks."""

    name: str
    columns: dict[str, str]
    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: dict[str, tuple[dict[str, str], str]] = field(default_factory=dict)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], ", ".join(f"`{c}` {spark_type(t)}" for c, t in self.columns.items()))

    def violations(self, df: DataFrame, others: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        out = {}
        if self.primary_key:
            out["23505 primary key"] = dml.duplicates(df, self.primary_key)
        if need := [*self.primary_key, *self.not_null]:
            out["23502 not null"] = dml.null_violations(df, need)
        for u in self.unique:
            out[f"23505 unique {u}"] = dml.duplicates(df, u)
        for n, c in self.checks.items():
            out[f"23514 {n}"] = dml.check_violations(df, F.expr(c))
        for n, (fk, parent) in self.foreign_keys.items():
            out[f"23503 {n}"] = dml.orphans(df, (others or {})[parent], fk)
        return out

    def validate(self, df: DataFrame, others: dict[str, DataFrame] | None = None) -> None:
        for what, bad in self.violations(df, others).items():
            dml.enforce(bad, what[:5], f"{self.name}: {what[6:]}")


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return df.withColumn(name, (default if isinstance(default, Column) else F.lit(default)).cast(spark_type(kind)))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def alter_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Values that don't convert become null."""
    return df.withColumn(name, F.col(name).try_cast(spark_type(kind)))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)
