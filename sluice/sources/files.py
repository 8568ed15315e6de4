"""File sources and sinks: delimited COPY, appends, backups, lazy row streams, and database imports."""

from __future__ import annotations

import os
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType


def _options(delimiter: str, header: bool, null: str, quote: str, escape: str) -> dict[str, str]:
    return {"sep": delimiter, "header": str(header).lower(), "nullValue": null, "emptyValue": "", "quote": quote, "escape": escape}


def copy_to(df: DataFrame, path: str, delimiter: str = "\t", header: bool = False, null: str = "\\N", quote: str = '"', escape: str = '"') -> None:
    """COPY ... TO: delimited text, one file a partition."""
    df.write.options(**_options(delimiter, header, null, quote, escape)).csv(path)


def copy_from(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = "\t", header: bool = False, null: str = "\\N", quote: str = '"', escape: str = '"') -> DataFrame:
    """COPY ... FROM with a declared schema; a malformed row fails."""
    return spark.read.schema(schema).options(mode="FAILFAST", **_options(delimiter, header, null, quote, escape)).csv(path)


def append(df: DataFrame, path: str) -> None:
    """INSERT ... SELECT and bulk copy: new files beside those that are there."""
    df.write.mode("append").parquet(path)


def backup(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time; the whole result is never held."""
    return df.toLocalIterator(prefetchPartitions=True)


def import_sqlite(spark: SparkSession, path: str, name: str, rows_a_task: int = 200_000) -> DataFrame:
    """A table of an SQLite file that driver and executors can read: its declared columns, rows in ranges of the row id."""
    kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary", "BOOL": "boolean"}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        quoted = '"' + name.replace('"', '""') + '"'
        cols = [(r[1], next((t for k, t in kinds.items() if k in (r[2] or "").upper()), "string")) for r in db.execute(f"PRAGMA table_info({quoted})")]
        if not cols:
            raise ValueError(f"no table {name} in {path}")
        least, most = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
    least, most = least or 0, most or 0

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in b["id"].tolist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT * FROM {quoted} WHERE rowid >= ? AND rowid < ?", (lo, lo + rows_a_task)).fetchall()
                got = pd.DataFrame(rows, columns=[c for c, _ in cols], dtype=object)
                for c, t in cols:
                    if t == "boolean":
                        got[c] = got[c].map(lambda v: None if v is None else bool(v))
                yield got

    ranges = spark.range(least, most + 1, rows_a_task)
    return ranges.repartition(max(1, (most - least) // rows_a_task + 1)).mapInPandas(read, ", ".join(f"`{c}` {t}" for c, t in cols))


def import_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of any database with a JDBC driver on the class path, read in ``parts`` ranges of ``key``."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def pack_derby(spark: SparkSession, name: str, create: str, rows: list[tuple]) -> tuple[str, str]:
    """(url, driver) of a small database with one table, built on the driver and handed to all executors as a jar.

    A Derby database in memory or in a folder is open in one JVM only, so a table that one executor writes is not
    there for the next; one in a jar is read-only, and every JVM opens its own copy. ``create`` is the table's DDL.
    """
    import atexit
    import shutil
    import tempfile
    import uuid

    driver, db = "org.apache.derby.iapi.jdbc.AutoloadedDriver", f"sluice_{uuid.uuid4().hex}"
    jvm, top = spark._jvm, tempfile.mkdtemp(prefix="sluice-")
    top = os.path.realpath(top)
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    jdbc, none = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), jvm.java.util.Properties()
    con = jdbc.connect(f"jdbc:derby:{top}/{db};create=true", none)
    con.setAutoCommit(False)
    con.createStatement().execute(create)
    put = con.prepareStatement(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})") if rows else None
    for r in rows:
        for i, v in enumerate(r, 1):
            put.setObject(i, v)
        put.addBatch()
    if put:
        put.executeBatch()
    con.commit()
    con.close()
    try:
        jdbc.connect(f"jdbc:derby:{top}/{db};shutdown=true", none)
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # Derby says by it that the database is down
            raise
    with zipfile.ZipFile(jar := f"{top}/{db}.jar", "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(f"{top}/{db}"):
            for f in names:
                if not f.endswith(".lck"):
                    z.write(f"{d}/{f}", os.path.relpath(f"{d}/{f}", top))
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{db}", driver
