"""A stored index of JSON payloads: one row a field and value, sorted, so that a condition reads the row groups it may match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import json_ops
from sluice.operators import filters, fulltext


@dataclass(frozen=True)
class PayloadIndex:
    """Entries (field, kind, number, text, key) under ``at``, in folders by field."""

    spark: SparkSession
    at: str
    key: str
    fields: tuple[str, ...]

    @staticmethod
    def build(df: DataFrame, key: str, payload: str, fields: list[str], at: str) -> PayloadIndex:
        """Indexes strings (whole and by word), integers and booleans of the named top-level fields."""
        parsed = F.try_parse_json(F.col(payload))
        entries = []
        for f in fields:
            kind = F.schema_of_variant(F.try_variant_get(parsed, json_ops.path_of(f), "variant"))
            text, number = json_ops.text(payload, f), json_ops.typed(payload, f, "bigint")
            entries.append(F.struct(F.lit(f).alias("field"), kind.alias("kind"), number.alias("number"), text.alias("text"), fulltext.tokens(text).alias("words")))
        rows = df.where(F.col(payload).isNotNull()).select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*").where("kind IN ('STRING', 'BIGINT', 'BOOLEAN')")
        whole = rows.select("field", "kind", "number", "text", key)
        words = rows.where("kind = 'STRING'").select("field", F.lit("WORD").alias("kind"), F.lit(None).cast("bigint").alias("number"), F.explode(F.array_distinct("words")).alias("text"), key)
        every = whole.unionByName(words)
        every.repartitionByRange("field", "kind", "number", "text", key).sortWithinPartitions("field", "kind", "number", "text", key).write.partitionBy("field", "kind").parquet(at)
        return PayloadIndex(df.sparkSession, at, key, tuple(fields))

    def _entries(self, c: dict) -> Column | None:
        """The entries of a condition; None if the index can't tell (doubles, places, other fields)."""
        if c["key"] not in self.fields:
            return None
        of = lambda kind: (F.col("field") == c["key"]) & (F.col("kind") == kind)
        if "match" in c:
            v = c["match"]["value"]
            if isinstance(v, bool):
                return of("BOOLEAN") & (F.col("text") == str(v).lower())
            if isinstance(v, str):
                return of("STRING") & (F.col("text") == v)
            return of("BIGINT") & (F.col("number") == v) if isinstance(v, int) else None
        if "range" in c:
            out, x = of("BIGINT"), F.col("number")
            for op, v in c["range"].items():
                out = out & {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
            return out
        if "full_text" in c:
            words = fulltext.parse(c["full_text"]["query"])[0]
            return of("WORD") & F.col("text").isin(words) if words and c["full_text"].get("mode", "all") == "any" else None
        return None

    def candidates(self, f: str | dict) -> DataFrame | None:
        """Keys that may pass: those of each indexed condition that must hold, joined; None if none is indexed."""
        parsed, out = filters.parse(f), None
        for on in (self._entries(c) for c in parsed.get("must", [])):
            if on is not None:
                keys = self.spark.read.parquet(self.at).where(on).select(self.key).distinct()
                out = keys if out is None else out.join(keys, self.key, "left_semi")
        return out

    def search(self, df: DataFrame, payload: str, f: str | dict) -> DataFrame:
        """Rows that pass: candidates by the index, then the whole filter; without candidates every row is judged."""
        keys = self.candidates(f)
        rows = df if keys is None else df.join(keys, self.key, "left_semi")
        return rows.where(filters.column(payload, f))
