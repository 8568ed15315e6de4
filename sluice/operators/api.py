"""Requests of the vector service as functions: what an endpoint would be given comes in, a DataFrame goes out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sluice.operators import filters
from sluice.operators.hnsw import Collection


class Service:
    """Named collections and the requests on them; a change makes the state that the next request finds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def request(self, method: str, path: str, body: dict | None = None) -> DataFrame | None:
        """PUT or DELETE /collections/c, and of its points: POST (upsert), GET all or one, DELETE by ids; POST .../search."""
        body = body or {}
        m = re.fullmatch(r"/collections/(\w+)(?:/(points|search)(?:/(\d+))?)?", path)
        if not m:
            raise ValueError(f"no such path: {path}")
        name, what, one = m.groups()
        if what is None:
            if method == "PUT":
                self.known[name] = Collection(body["rows"])
            elif method == "DELETE":
                del self.known[name]
            else:
                return self.known[name].rows
            return None
        c = self.known[name]
        if what == "search":
            on = filters.column("payload", body["filter"]) if body.get("filter") else None
            return c.search(body["vector"], body.get("top", 10), on, body.get("metric", "euclidean"))
        if method == "GET":
            return c.get(int(one)) if one else c.rows
        if method == "POST":
            self.known[name] = c.upsert(body["rows"])
        elif method == "DELETE":
            self.known[name] = c.delete(*([int(one)] if one else body["ids"]))
        return None
