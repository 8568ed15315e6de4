"""Functions and procedures: SQL functions that Catalyst inlines, a registry of Python procedures, cursors and triggers."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

#: SQLSTATEs by the names that handlers use.
STATES = {"division_by_zero": "22012", "no_data_found": "P0002", "too_many_rows": "P0003", "unique_violation": "23505", "foreign_key_violation": "23503", "check_violation": "23514"}


class ProcedureError(Exception):
    def __init__(self, name: str, message: str = ""):
        super().__init__(f"{STATES.get(name, name)}: {message or name}")
        self.state = STATES.get(name, name)


def create_function(spark: SparkSession, name: str, params: dict[str, str], returns: str, body: str, replace: bool = True) -> None:
    """CREATE FUNCTION: a scalar SQL function, usable in any query of the session."""
    args = ", ".join(f"{p} {t}" for p, t in params.items())
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def create_aggregate(spark: SparkSession, name: str, returns: str, fn: Callable) -> None:
    """CREATE AGGREGATE: a user's aggregate of Arrow batches, usable in any query of the session; ``fn`` gets a group's values as pandas Series."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    spark.udf.register(name, pandas_udf(fn, returns, PandasUDFType.GROUPED_AGG))


def drop_function(spark: SparkSession, name: str, if_exists: bool = True) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION {'IF EXISTS ' if if_exists else ''}{name}")


class Procedures:
    """Named procedures, told apart by their number of arguments: Python callables (spark, **args) that return a DataFrame or a dict of OUT values."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def create(self, name: str, fn: Callable, replace: bool = False) -> None:
        key = (name.lower(), len(inspect.signature(fn).parameters) - 1)
        if key in self.known and not replace:
            raise ProcedureError("42723", f"{name} exists")
        self.known[key] = fn

    def drop(self, name: str, if_exists: bool = False) -> None:
        found = [k for k in self.known if k[0] == name.lower()]
        if not found and not if_exists:
            raise ProcedureError("42883", f"no procedure {name}")
        for k in found:
            del self.known[k]

    def call(self, name: str, /, *args, **named):
        """EXEC / CALL: by position or name; defaults fill what is left out."""
        fits = []
        for (n, _), fn in self.known.items():
            if n == name.lower():
                try:
                    fits.append((fn, inspect.signature(fn).bind(self.spark, *args, **named)))
                except TypeError:
                    continue
        if not fits:
            raise ProcedureError("42883", f"no procedure {name} takes these arguments")
        fn, bound = min(fits, key=lambda f: len(inspect.signature(f[0]).parameters))
        return fn(*bound.args, **bound.kwargs)


def select_into(df: DataFrame, strict: bool = False) -> Row | None:
    """SELECT INTO: the only row; none is None (an error if strict), more is an error."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ProcedureError("too_many_rows")
    if not rows and strict:
        raise ProcedureError("no_data_found")
    return rows[0] if rows else None


def for_each(spark: SparkSession, lo: int, hi: int, name: str = "i") -> DataFrame:
    """FORALL: the indices as rows, for one statement over all of them."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", name)


class Cursor:
    """DECLARE, OPEN, FETCH, CLOSE over a result that is read a partition at a time."""

    def __init__(self, df: DataFrame):
        self.df, self.rows = df, None

    def open(self) -> Cursor:
        self.rows: Iterator[Row] | None = self.df.toLocalIterator()
        return self

    def fetch(self, n: int = 1) -> list[Row]:
        if self.rows is None:
            raise ProcedureError("24000", "the cursor is not open")
        return [r for _, r in zip(range(n), self.rows)]

    def close(self) -> None:
        self.rows = None


class Triggers:
    """Hooks around a change of table state: fn(inserted, deleted), before it may replace the inserted rows."""

    def __init__(self):
        self.hooks: list[tuple[str, str, Callable]] = []

    def on(self, when: str, event: str, fn: Callable) -> None:
        if when not in ("BEFORE", "AFTER", "INSTEAD OF") or event not in ("INSERT", "UPDATE", "DELETE", "TRUNCATE"):
            raise ValueError((when, event))
        self.hooks.append((when, event, fn))

    def run(self, event: str, target: DataFrame, inserted: DataFrame, deleted: DataFrame, apply: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The new state; INSTEAD OF hooks return it themselves."""
        for when, e, fn in self.hooks:
            if e == event and when == "BEFORE" and (out := fn(inserted, deleted)) is not None:
                inserted = out
        instead = [fn for when, e, fn in self.hooks if e == event and when == "INSTEAD OF"]
        state = instead[-1](inserted, deleted) if instead else apply(target, inserted, deleted)
        for when, e, fn in self.hooks:
            if e == event and when == "AFTER":
                fn(inserted, deleted)
        return state
