"""JSON operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import json_ops as J
from sluice.plans import dialect
from sluice.plans.registry import op
from sluice.sources.tables import register, table

_DOC = "concat('{\"a\":{\"b\":[', event_id, ',', event_id + 1, '],\"n\":null},\"t\":\"', event_type, '\",\"k\":', props->>'$.k', '}')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a nested document made of their columns."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("doc", F.concat(F.lit('{"a":{"b":['), F.col("event_id").cast("string"), F.lit(","), (F.col("event_id") + 1).cast("string"), F.lit('],"n":null},"t":"'), "event_type", F.lit('","k":'), J.text("props", "k"), F.lit("}")))


def _json(name: str, oracle: str | None, make, where: bool = False) -> None:
    body = f"(SELECT event_id, {_DOC} AS doc, props FROM events) t"
    sql = oracle and (f"SELECT event_id FROM {body} WHERE {oracle}" if where else f"SELECT event_id, {oracle} AS v FROM {body}")

    @op(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _docs(spark, sf_dir)
        return d.where(make()).select("event_id") if where else d.select("event_id", make().alias("v"))


_json("jsn_01_arrow_typed", "CAST(doc->'$.k' AS BIGINT)", lambda: J.typed("doc", "k", "bigint"))
_json("jsn_02_arrow_text", "doc->>'$.t'", lambda: J.text("doc", "t"))
_json("jsn_03_path_array", "doc->>'$.a.b[1]'", lambda: J.text("doc", "{a,b,1}"))
_json("jsn_04_path_out_of_bounds", "doc->>'$.a.b[7]'", lambda: J.text("doc", "$.a.b[7]"))
_json("jsn_05_json_extract", "CAST(json_extract(doc, '$.a.b[0]') AS DOUBLE)", lambda: J.typed("doc", "$.a.b[0]", "double"))
_json("jsn_06_json_value", "json_extract_string(doc, '$.t')", lambda: J.text("doc", "$.t"))
_json("jsn_07_contains", "json_contains(doc, '{\"t\":\"click\"}')", lambda: J.contains_json("doc", '{"t":"click"}'), True)
_json("jsn_07_contains_nested", "json_contains(doc, '{\"a\":{\"b\":[7]}}')", lambda: J.contains_json("doc", '{"a":{"b":[7]}}'), True)
_json("jsn_08_contained_by", "json_contains('{\"k\":5,\"x\":1}', props)", lambda: J.contains_json(F.lit('{"k":5,"x":1}'), F.col("props")), True)
_json("jsn_09_has_key", "list_contains(json_keys(doc), 'a')", lambda: J.has_key("doc", "a"))
_json("jsn_10_any_key", "list_has_any(json_keys(doc), ['zz', 'k'])", lambda: J.has_any("doc", "zz", "k"))
_json("jsn_11_all_keys", "list_has_all(json_keys(doc), ['a', 'k', 't'])", lambda: J.has_all("doc", "a", "k", "t"))
_json("jsn_12_build_object", "concat('{\"id\":', event_id, ',\"none\":null}')", lambda: J.build_object(id=F.col("event_id"), none=F.lit(None).cast("string")))
_json("jsn_13_build_array", "concat('[', event_id, ',\"x\",null]')", lambda: J.build_array(F.col("event_id"), F.lit("x"), F.lit(None).cast("string")))
_json("jsn_14_strip_nulls", "replace(doc, ',\"n\":null', '')", lambda: J.strip_nulls("doc"))
_json("jsn_15_set", "replace(doc, '\"n\":null', '\"n\":{\"z\":1}')", lambda: J.set_path("doc", "$.a.n.z", "1"))
_json("jsn_16_insert", "replace(doc, '\"b\":[', '\"b\":[0,')", lambda: J.insert_path("doc", "$.a.b[0]", "0"))
_json("jsn_17_path_exists", "json_exists(doc, '$.a.b[1]')", lambda: J.path_exists("doc", "$.a.b[1]"))
_json("jsn_18_path_query_first", "CAST(event_id AS VARCHAR)", lambda: J.path_query("doc", "$.a.b[*]"))
_json("jsn_19_malformed_is_null", "NULL::BIGINT", lambda: J.typed(F.concat(F.lit("{"), "doc"), "k", "bigint"))


@op("jsn_20_sql_operators", "SELECT event_id, props->>'$.k' AS k FROM events WHERE (props->>'$.k') = '9' AND list_contains(json_keys(props), 'k')")
def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["events"])
    return dialect.sql(spark, "SELECT event_id, props ->> 'k' AS k FROM events WHERE props ->> 'k' = @v AND props ? 'k' AND props @> '{\"k\": 9}'", v="9")
