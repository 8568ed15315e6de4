"""A SQL front end: rewrites the syntax that Spark's parser lacks, then runs the statement.

TOP n, OFFSET m ROWS FETCH NEXT n ROWS ONLY, op ANY/SOME/ALL (subquery), IIF, CHARINDEX, JSON arrows
(-> ->> #> #>>), containment and key operators (@> <@ ? ?| ?&) with literal right sides, @named parameters,
and the ICU spelling of collations. Strings and quoted names are never touched.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sluice.functions.json_ops import path_of

_LITERAL = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"")


def _hide(sql: str) -> tuple[str, list[str]]:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    return _LITERAL.sub(keep, sql), kept


def _show(sql: str, kept: list[str]) -> str:
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], sql)


def _close(sql: str, at: int) -> int:
    """Where the parenthesis that opens at ``at`` closes."""
    depth = 0
    for i in range(at, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if not depth:
            return i
    raise ValueError("unbalanced parentheses")


_QUANTIFIED = re.compile(r"((?:[\w.]+|\x00\d+\x00))\s*(<=|>=|<>|!=|=|<|>)\s*(ANY|SOME|ALL)\s*(?=\()", re.I)


def _quantified(sql: str) -> str:
    while m := _QUANTIFIED.search(sql):
        end = _close(sql, m.end())
        left, op, kind, sub = m[1], m[2], m[3].upper(), sql[m.end() + 1 : end]
        if op == "=" and kind != "ALL":
            new = f"{left} IN ({sub})"
        elif op in ("<>", "!=") and kind == "ALL":
            new = f"{left} NOT IN ({sub})"
        else:
            rows = f"({sub}) AS _r(_v)"
            least = op[0] == ">" if kind != "ALL" else op[0] == "<"
            edge = f"{left} {op} (SELECT {'min' if least else 'max'}(_v) FROM {rows})"
            if op in ("=", "<>", "!="):
                new = f"EXISTS (SELECT 1 FROM {rows} WHERE {left} <> _v)" if kind != "ALL" else f"NOT EXISTS (SELECT 1 FROM {rows} WHERE NOT ({left} <=> _v))"
            elif kind != "ALL":
                new = f"coalesce({edge}, false)"
            else:
                new = f"((SELECT count(*) FROM {rows}) = 0 OR ({edge} AND (SELECT count(*) = count(_v) FROM {rows})))"
        sql = sql[: m.start()] + new + sql[end + 1 :]
    return sql


def _paging(sql: str) -> str:
    if m := re.match(r"\s*SELECT\s+(DISTINCT\s+)?TOP\s*(?:\(\s*(\d+)\s*\)|(\d+))\s+", sql, re.I):
        sql = f"SELECT {m[1] or ''}{sql[m.end():].rstrip().rstrip(';')} LIMIT {m[2] or m[3]}"
    return re.sub(r"\bOFFSET\s+(\d+)\s+ROWS?(?:\s+FETCH\s+(?:NEXT|FIRST)\s+(\d+)\s+ROWS?\s+ONLY)?", lambda m: (f"LIMIT {m[2]} " if m[2] else "") + f"OFFSET {m[1]}", sql, flags=re.I)


def _json(sql: str, kept: list[str]) -> str:
    lit = lambda i: kept[int(i)][1:-1].replace("''", "'")
    arrow = re.compile(r"([\w.]+(?:\([^()]*\))?)\s*(#>>|#>|->>|->)\s*(?:\x00(\d+)\x00|(\d+))")
    while m := arrow.search(sql):
        path = path_of(int(m[4]) if m[4] else lit(m[3]))
        sql = f"{sql[: m.start()]}get_json_object({m[1]}, '{path}'){sql[m.end():]}"
    keys = lambda i: ", ".join(f"'{k}'" for k in re.findall(r'"([^"]*)"', lit(i)) or [lit(i)])
    sql = re.sub(r"([\w.]+)\s*\?\|\s*\x00(\d+)\x00", lambda m: f"coalesce(arrays_overlap(json_object_keys({m[1]}), array({keys(m[2])})), false)", sql)
    sql = re.sub(r"([\w.]+)\s*\?&\s*\x00(\d+)\x00", lambda m: f"coalesce(size(array_except(array({keys(m[2])}), json_object_keys({m[1]}))) = 0, false)", sql)
    sql = re.sub(r"([\w.]+)\s*\?\s*\x00(\d+)\x00", lambda m: f"coalesce(array_contains(json_object_keys({m[1]}), \x00{m[2]}\x00), false)", sql)
    sql = re.sub(r"([\w.]+)\s*@>\s*(\x00\d+\x00|[\w.]+)", r"json_contains(\1, \2)", sql)
    return re.sub(r"([\w.]+)\s*<@\s*(\x00\d+\x00|[\w.]+)", r"json_contains(\2, \1)", sql)


def _charindex(sql: str) -> str:
    while m := re.search(r"\bCHARINDEX\s*(?=\()", sql, re.I):
        end = _close(sql, m.end())
        args, depth, last, inner = [], 0, 0, sql[m.end() + 1 : end]
        for i, c in enumerate(inner + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                args.append(inner[last:i].strip())
                last = i + 1
        start = args[2] if len(args) > 2 else "1"
        sql = f"{sql[: m.start()]}CAST(coalesce(locate(lower({args[0]}), lower({args[1]}), {start}), 0) AS BIGINT){sql[end + 1 :]}"
    return sql


def rewrite(sql: str) -> str:
    """The statement in Spark's own dialect."""
    s, kept = _hide(sql)
    s = _paging(s)
    s = _json(s, kept)
    s = _quantified(s)
    s = _charindex(s)
    s = re.sub(r"\bIIF\s*\(", "if(", s, flags=re.I)
    s = re.sub(r"(?<![\w@])@(\w+)", r":\1", s)
    s = re.sub(r"\bCOLLATE\s+\x00(\d+)\x00", lambda m: "COLLATE " + kept[int(m[1])].strip("\"'`").removesuffix("-x-icu").split("-")[0], s, flags=re.I)
    return _show(s, kept)


def split(script: str) -> list[str]:
    """Statements of a script: semicolons in strings, $$ bodies and BEGIN ... END blocks don't part them."""
    out, now, depth = [], [], 0
    for m in re.finditer(r"\$\$.*?\$\$|'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\bBEGIN\b|\bCASE\b|\bEND\b|;|[^;'\"$\-/\w]+|\w+|.", script, re.S | re.I):
        t = m[0]
        if t.startswith("--") or t.startswith("/*"):
            continue
        if t.upper() in ("BEGIN", "CASE"):
            depth += 1
        elif t.upper() == "END":
            depth = max(0, depth - 1)
        if t == ";" and not depth:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(t)
    out.append("".join(now).strip())
    return [s for s in out if s]


def sql(spark: SparkSession, statement: str, **params) -> DataFrame:
    """Runs a statement of the wider dialect, with @name or :name parameters."""
    if "@>" in statement or "<@" in statement:
        from sluice.functions.json_ops import _contains

        spark.udf.register("json_contains", _contains)
    return spark.sql(rewrite(statement), args=params or None)
