"""Payload filters: {must, should, must_not} of match, range, geo_radius and full_text conditions, as a Column."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import json_ops
from sluice.operators import fulltext, geo

_KINDS = {"match", "range", "geo_radius", "full_text"}


class FilterError(ValueError):
    pass


def parse(text: str | dict) -> dict:
    """The filter, checked: no unknown keys, one kind of condition each."""
    f = json.loads(text) if isinstance(text, str) else text
    if not isinstance(f, dict) or set(f) - {"must", "should", "must_not"}:
        raise FilterError(f"a filter has must, should and must_not only: {f}")
    for c in (c for part in f.values() for c in part):
        if "key" not in c or len(set(c) & _KINDS) != 1 or set(c) - _KINDS - {"key"}:
            raise FilterError(f"a condition has a key and one of {sorted(_KINDS)}: {c}")
    return f


def _number(payload: str, key: str) -> Column:
    return json_ops.typed(payload, key, "double")


def _condition(payload: str, c: dict) -> Column:
    key = c["key"]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(payload)), json_ops.path_of(key), "variant"))
    if "match" in c:
        v = c["match"]["value"]
        if isinstance(v, bool):
            return (kind == "BOOLEAN") & (json_ops.typed(payload, key, "boolean") == v)
        if isinstance(v, str):
            return (kind == "STRING") & (json_ops.text(payload, key) == v)
        if isinstance(v, int):
            return (kind == "BIGINT") & (json_ops.typed(payload, key, "bigint") == v)
        return F.abs(_number(payload, key) - v) < 1e-6
    if "range" in c:
        x, out = json_ops.typed(payload, key, "bigint"), kind == "BIGINT"
        for op, v in c["range"].items():
            out = out & {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
        return out
    if "geo_radius" in c:
        g = c["geo_radius"]
        lat = F.coalesce(_number(payload, f"$.{key}.lat"), _number(payload, f"$.{key}[0]"))
        lon = F.coalesce(_number(payload, f"$.{key}.lon"), _number(payload, f"$.{key}[1]"))
        return geo.haversine(lat, lon, g["center"]["lat"], g["center"]["lon"]) <= g["radius"]
    t = c["full_text"]
    words = fulltext.tokens(json_ops.text(payload, key))
    terms = fulltext.parse(t["query"])[0]
    out = F.lit(t.get("mode", "all") == "all")
    for w in terms:
        out = out & F.array_contains(words, w) if t.get("mode", "all") == "all" else out | F.array_contains(words, w)
    for w in fulltext.parse(t.get("not", ""))[0]:
        out = out & ~F.array_contains(words, w)
    return out


def column(payload: str, text: str | dict) -> Column:
    """Whether a JSON payload passes. should counts only where must is empty; a null payload passes the empty filter alone."""
    f = parse(text)
    sure = lambda c: F.coalesce(_condition(payload, c), F.lit(False))
    if not any(f.get(k) for k in ("must", "should", "must_not")):
        return F.lit(True)
    out = F.lit(True)
    for c in f.get("must", []):
        out = out & sure(c)
    if f.get("should") and not f.get("must"):
        some = F.lit(False)
        for c in f["should"]:
            some = some | sure(c)
        out = out & some
    for c in f.get("must_not", []):
        out = out & ~sure(c)
    return F.when(F.col(payload).isNull(), F.lit(False)).otherwise(out)
