"""Every registered query with an oracle gives the oracle's rows."""

import math
import os

import duckdb
import pytest

from sluice.plans.registry import load
from sluice.sources.tables import TABLES

OPS = load()


def duck(sf):
    c = duckdb.connect()
    for n in TABLES:
        p = f"{sf}/{n}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n, o in OPS.items() if o.sql])
def test_matches_oracle(spark, sf, con, name):
    got = OPS[name].query(spark, sf)
    want = con.sql(OPS[name].sql)
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    their = dict(zip(want.columns, map(str, want.types)))
    for c, t in got.dtypes:
        assert kinds.get(t, their[c]) == their[c], (c, t, their[c])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, o in OPS.items() if not o.sql])
def test_runs(spark, sf, name):
    assert OPS[name].query(spark, sf).count() >= 0
