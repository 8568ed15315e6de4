"""JSON operators over text columns. Paths, keys and flat containment are built-in expressions; only nested rewriting is an Arrow UDF."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_of(path: str | int) -> str:
    """A key, an index, ``$.a.b[0]`` or ``{a,b,0}`` as a JSON path."""
    if isinstance(path, int):
        return f"$[{path}]"
    if path.startswith("{"):
        return "$" + "".join(f"[{p}]" if p.lstrip("-").isdigit() else f".{p}" for p in path[1:-1].split(",") if p)
    return path if path.startswith("$") else f"$.{path}"


def text(doc, path: str | int) -> Column:
    """``->>``, ``#>>`` and JSON_VALUE: the value as text."""
    return F.get_json_object(_c(doc), path_of(path))


def typed(doc, path: str | int, kind: str) -> Column:
    """``->``, ``#>`` and JSON_EXTRACT: the value as the given type, null where it is another."""
    return F.try_variant_get(F.try_parse_json(_c(doc)), path_of(path), kind)


def has_key(doc, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(doc)), key), F.lit(False))


def has_any(doc, *keys: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(_c(doc)), F.array(*map(F.lit, keys))), F.lit(False))


def has_all(doc, *keys: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(_c(doc)))) == 0, F.lit(False))


def contains(a, b) -> bool:
    """Whether parsed JSON ``a`` holds ``b``: objects by fields, arrays by elements, a scalar in an array, numbers by value."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(contains(x, b) for x in a)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def _load(s):
    try:
        return True, json.loads(s)
    except (TypeError, ValueError):
        return False, None


@F.pandas_udf(T.BooleanType())
def _contains(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        (ok1, p), (ok2, q) = _load(x), _load(y)
        out.append(ok1 and ok2 and contains(p, q))
    return pd.Series(out, dtype=bool)


def contains_json(doc, candidate) -> Column:
    """``@>``; for ``<@`` swap the two. A flat object of scalars given as text becomes built-in comparisons."""
    if isinstance(candidate, str):
        ok, v = _load(candidate)
        if ok and isinstance(v, dict) and all(isinstance(x, (str, int)) and not isinstance(x, bool) for x in v.values()):
            out = F.lit(True)
            for k, x in v.items():
                out = out & F.coalesce(typed(doc, k, "string" if isinstance(x, str) else "bigint") == x, F.lit(False))
            return out
        candidate = F.lit(candidate)
    return _contains(_c(doc), candidate)


def _rewrite(fn):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            ok, v = _load(x)
            out.append(json.dumps(fn(v), ensure_ascii=False, separators=(",", ":")) if ok else None)
        return pd.Series(out, dtype=object)

    return run


def _strip(v):
    if isinstance(v, dict):
        return {k: _strip(x) for k, x in v.items() if x is not None}
    return [_strip(x) for x in v] if isinstance(v, list) else v


def strip_nulls(doc) -> Column:
    """JSONB_STRIP_NULLS: object fields that are null go, at any depth."""
    return _rewrite(_strip)(_c(doc))


def _steps(path: str) -> list:
    out = []
    for p in path_of(path)[1:].replace("[", ".[").split("."):
        if p:
            out.append(int(p[1:-1]) if p.startswith("[") else p)
    return out


def _put(v, steps, new, insert):
    if not steps:
        return new
    k = steps[0]
    if isinstance(k, int):
        v = list(v) if isinstance(v, list) else []
        k = k + len(v) if k < 0 else k
        if len(steps) == 1 and insert:
            v.insert(max(k, 0), new)
        else:
            v += [None] * (k + 1 - len(v))
            v[k] = _put(v[k], steps[1:], new, insert)
        return v
    v = dict(v) if isinstance(v, dict) else {}
    if len(steps) == 1 and insert and k in v:
        return v
    v[k] = _put(v.get(k), steps[1:], new, insert)
    return v


def set_path(doc, path: str, value: str) -> Column:
    """JSONB_SET: puts JSON ``value`` at the path and makes what is missing on the way."""
    return _rewrite(lambda v: _put(v, _steps(path), json.loads(value), False))(_c(doc))


def insert_path(doc, path: str, value: str) -> Column:
    """JSONB_INSERT: before an array index, or as a new field; a field that is there stays."""
    return _rewrite(lambda v: _put(v, _steps(path), json.loads(value), True))(_c(doc))


def _find(v, steps):
    if not steps:
        yield v
    elif steps[0] == "*":
        for x in v if isinstance(v, list) else v.values() if isinstance(v, dict) else ():
            yield from _find(x, steps[1:])
    elif isinstance(steps[0], int):
        if isinstance(v, list) and 0 <= steps[0] < len(v):
            yield from _find(v[steps[0]], steps[1:])
    elif isinstance(v, dict) and steps[0] in v:
        yield from _find(v[steps[0]], steps[1:])


def path_query(doc, path: str) -> Column:
    """JSONB_PATH_QUERY: the first match as JSON text; ``[*]`` goes over elements."""
    steps = _steps(path.replace("[*]", ".*"))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            ok, v = _load(x)
            hit = list(_find(v, steps))[:1] if ok else []
            out.append(json.dumps(hit[0], ensure_ascii=False, separators=(",", ":")) if hit else None)
        return pd.Series(out, dtype=object)

    return run(_c(doc))


def path_exists(doc, path: str) -> Column:
    return path_query(doc, path).isNotNull() if "[*]" in path else F.coalesce(F.get_json_object(_c(doc), path_of(path)).isNotNull(), F.lit(False))


def build_object(**fields) -> Column:
    """JSONB_BUILD_OBJECT, nulls kept."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def build_array(*values) -> Column:
    """JSONB_BUILD_ARRAY of values of any types."""
    item = lambda v: F.coalesce(F.regexp_extract(F.to_json(F.struct(_c(v).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(""))
    return F.concat(F.lit("["), F.concat_ws(",", *[F.when(_c(v).isNull(), F.lit("null")).otherwise(item(v)) for v in values]), F.lit("]"))


def index_tokens(doc) -> Column:
    """Inverted-index tokens of a document: ``path`` and ``path=value`` of every field, elements under their array's path."""

    def walk(v, at):
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{at}.{k}" if at else k
                yield p
                yield from walk(x, p)
        elif isinstance(v, list):
            for x in v:
                yield from walk(x, at)
        else:
            yield f"{at}={v if isinstance(v, str) else json.dumps(v)}"

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(walk(v, ""))) if ok else [] for ok, v in map(_load, s)])

    return run(_c(doc))
