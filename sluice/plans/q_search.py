"""Vector, text, geo and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import filters, fulltext, geo, hnsw, hybrid, vectors
from sluice.plans.registry import op
from sluice.session import scratch
from sluice.sources.tables import table

_E = "CAST(embedding AS DOUBLE[])"
_Q = f"(SELECT {_E} FROM embeddings WHERE vec_id = 0)"


def _vecs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings")
    return e, vectors.reference(spark, e, 0)


def _distance(name: str, oracle: str, make) -> None:
    @op(name, f"SELECT vec_id, round({oracle}, 6) AS v FROM embeddings")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, q = _vecs(spark, sf_dir)
        return e.select("vec_id", F.round(make("embedding", q), 6).alias("v"))


_distance("vec_01_euclidean", f"list_distance({_E}, {_Q})", vectors.l2)
_distance("vec_01_squared_euclidean", f"power(list_distance({_E}, {_Q}), 2)", vectors.squared_l2)
_distance("vec_02_cosine", f"list_cosine_similarity({_E}, {_Q})", vectors.cosine)
_distance("vec_03_dot", f"list_inner_product({_E}, {_Q})", vectors.dot)
_distance("vec_05_score_convention", f"1 - list_cosine_similarity({_E}, {_Q})", lambda a, b: vectors.score(a, b, "cosine"))


@op("vec_04_normalize", f"SELECT vec_id, round(list_extract({_E}, 1) * 3 / sqrt(list_inner_product({_E}, {_E}) * 9), 6) AS first FROM embeddings")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.normalize(tripled)[0], 6).alias("first"))


@op("vec_06_exact_knn", f"SELECT vec_id, round(power(list_distance({_E}, {_Q}), 2), 6) AS score FROM embeddings ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 10")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    return vectors.exact(e, q, 10).select("vec_id", F.round("score", 6).alias("score"))


@op("vec_06_exact_knn_many", f"""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s * s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS INTEGER) AS rank FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) <= 5""")
def knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.exact_many(e, e.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@op("vec_09_inverted_file_build", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM embeddings")
def ivf_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is in the list of its nearest centroid."""
    index = vectors.InvertedFile.build(table(spark, sf_dir, "embeddings"), 8)
    far = F.array(*[vectors.squared_l2("embedding", c) for c in index.centroids])
    wrong = F.get(far, F.col("cluster")) > F.array_min(far) + 1e-9
    return index.lists.agg(F.count("cluster").alias("n"), F.count_if(wrong).alias("misplaced"))


@op("vec_10_inverted_file_full_probe", f"SELECT vec_id, round(power(list_distance({_E}, {_Q}), 2), 6) AS score FROM embeddings ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 10")
def ivf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    index = vectors.InvertedFile.build(e, 8)
    return index.search(q, 10, probes=8).select("vec_id", F.round("score", 6).alias("score"))


_GRAPHS: dict[tuple[str, str], hnsw.Hnsw] = {}


def _graph(spark: SparkSession, sf_dir: str) -> hnsw.Hnsw:
    """The graph index of a folder's embeddings, built when first asked for in an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _GRAPHS:
        _GRAPHS[at] = hnsw.Hnsw.build(table(spark, sf_dir, "embeddings"), scratch(spark), shard_rows=512)
    return _GRAPHS[at]


def _recall(spark: SparkSession, sf_dir: str, index: hnsw.Hnsw, rows: DataFrame, where: DataFrame | None = None) -> DataFrame:
    """Of every 50th vector's 10 nearest among the rows, whether at least 0.95 are found, and whether nothing else is."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    got = index.search(queries, 10, where=where).select("query_id", "vec_id").withColumn("found", F.lit(1))
    want = vectors.exact_many(rows, e.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id").withColumn("wanted", F.lit(1))
    allowed = rows.select("vec_id").withColumn("allowed", F.lit(1))
    both = want.join(got, ["query_id", "vec_id"], "full").join(allowed, "vec_id", "left")
    return both.agg((F.count_if(F.expr("wanted = 1 AND found = 1")) >= 0.95 * F.count("wanted")).alias("recall_reached"), (F.count_if(F.expr("found = 1 AND allowed IS NULL")) == 0).alias("none_else"))


@op("vec_08_approximate_search", "SELECT TRUE AS recall_reached, TRUE AS none_else")
def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, _graph(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@op("vec_08_filtered_graph_search", "SELECT TRUE AS recall_reached, TRUE AS none_else")
def filtered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "embeddings").where("label = 2")
    return _recall(spark, sf_dir, _graph(spark, sf_dir), some, some.select("vec_id"))


@op("vec_07_graph_insert_and_delete", "SELECT TRUE AS recall_reached, TRUE AS none_else")
def graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of half the rows, the rest inserted (live ids again, to no effect), every third deleted."""
    e = table(spark, sf_dir, "embeddings")
    index = hnsw.Hnsw.build(e.where("vec_id % 2 = 0"), scratch(spark), shard_rows=512).insert(e, "1", 512).delete(e.where("vec_id % 3 = 0").select("vec_id"))
    return _recall(spark, sf_dir, index, e.where("vec_id % 3 != 0"))


@op("vec_07a_graph_defaults", "SELECT * FROM (VALUES (64, 16), (767, 16), (768, 16), (1536, 32)) v(dim, m)")
def graph_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, hnsw.default_m(d)) for d in (64, 767, 768, 1536)], "dim int, m int")


@op("vec_16_collection", f"""
WITH s AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 4 = 0 THEN 77 ELSE label END AS label FROM embeddings WHERE vec_id NOT IN (0, 5))
SELECT id, label, round(power(list_distance({_E}, {_Q}), 2), 6) AS score FROM s WHERE label = 77 ORDER BY list_distance({_E}, {_Q}), id LIMIT 8""")
def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert, delete and filtered search of records."""
    e, q = _vecs(spark, sf_dir)
    rows = e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("int").alias("label"))
    c = hnsw.Collection(rows).upsert(rows.where("id % 4 = 0").withColumn("label", F.lit(77))).delete(0, 5)
    return c.search(q, 8, F.col("label") == 77).join(c.rows.select("id", "label"), "id").select("id", "label", F.round("score", 6).alias("score"))


@op("vec_11_filtered", f"SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 5")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    return vectors.exact(e, q, 5, where=F.col("label") == 2).select("vec_id")


@op("vec_12_auto", f"SELECT vec_id FROM embeddings ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 7")
def auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    return vectors.search(e, q, 7).select("vec_id")


@op("vec_13_predicate", f"SELECT vec_id FROM embeddings WHERE vec_id % 3 = 1 ORDER BY -list_inner_product({_E}, {_Q}), vec_id LIMIT 6")
def predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    return vectors.exact(e, q, 6, "dot", where=F.col("vec_id") % 3 == 1).select("vec_id")


@op("vec_14_dimension_check", "SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.checked(table(spark, sf_dir, "embeddings"), "embedding", 64).agg(F.count("embedding").alias("n"))


@op("vec_15_text_embedding", "SELECT item_id, 32 AS dim, CASE WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, 1.0::DOUBLE AS to_doubled FROM benchmark WHERE len(text) > 0")
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings have length 1, and a text said twice points where it did."""
    b = table(spark, sf_dir, "benchmark").where("length(text) > 0")
    v, twice = vectors.hashed_embedding("text", 32), vectors.hashed_embedding(F.concat("text", F.lit(" "), "text"), 32)
    b = b.select("item_id", v.alias("v"), twice.alias("twice"))
    return b.select("item_id", F.size("v").alias("dim"), F.round(vectors.norm("v"), 6).alias("norm"), F.round(vectors.cosine("v", "twice"), 6).alias("to_doubled"))


_PAYLOAD = "concat('{\"type\":\"', event_type, '\",\"n\":', event_id, ',\"v\":', round(value, 3), ',\"odd\":', CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END, ',\"at\":{\"lat\":', event_id % 60, ',\"lon\":', event_id % 90, '}}')"
_EV = f"(SELECT event_id, event_type, value, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1 END AS payload FROM events)"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("n"), F.round("value", 3).alias("v"), (F.col("event_id") % 2 == 1).alias("odd"),
                              F.struct((F.col("event_id") % 60).alias("lat"), (F.col("event_id") % 90).alias("lon")).alias("at")))
    return e.select("event_id", "event_type", F.when(F.col("event_id") % 17 != 0, body).alias("payload"))


def _filter(name: str, f: dict, oracle: str) -> None:
    @op(name, f"SELECT event_id FROM {_EV} WHERE {oracle}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _payloads(spark, sf_dir).where(filters.column("payload", f)).select("event_id")


_ANY = {"key": "type", "match": {"value": "click"}}
_filter("flt_v1_grammar", {"must": [_ANY], "must_not": [{"key": "n", "range": {"gt": 1000}}]}, "payload IS NOT NULL AND event_type = 'click' AND event_id <= 1000")
_filter("flt_v2_should_only_without_must", {"must": [{"key": "n", "range": {"lt": 500}}], "should": [_ANY]}, "payload IS NOT NULL AND event_id < 500")
_filter("flt_v2_should", {"should": [_ANY, {"key": "n", "range": {"gte": 1990}}]}, "payload IS NOT NULL AND (event_type = 'click' OR event_id >= 1990)")
_filter("flt_v3_null_payload", {"must_not": [_ANY]}, "payload IS NOT NULL AND event_type <> 'click'")
_filter("flt_v4_match_bool", {"must": [{"key": "odd", "match": {"value": True}}, {"key": "n", "match": {"value": 33}}]}, "payload IS NOT NULL AND event_id = 33")
_filter("flt_v5_range_integers", {"must": [{"key": "n", "range": {"gte": 100, "lt": 200}}]}, "payload IS NOT NULL AND event_id >= 100 AND event_id < 200")
_filter("flt_v6_geo_radius", {"must": [{"key": "at", "geo_radius": {"center": {"lat": 10.0, "lon": 20.0}, "radius": 800000.0}}]},
        "payload IS NOT NULL AND 2 * 6371000 * atan2(sqrt(power(sin(radians(10 - event_id % 60) / 2), 2) + cos(radians(event_id % 60)) * cos(radians(10)) * power(sin(radians(20 - event_id % 90) / 2), 2)), sqrt(1 - (power(sin(radians(10 - event_id % 60) / 2), 2) + cos(radians(event_id % 60)) * cos(radians(10)) * power(sin(radians(20 - event_id % 90) / 2), 2)))) <= 800000")
_filter("flt_v7_full_text", {"must": [{"key": "type", "full_text": {"query": "Click purchase", "mode": "any"}}]}, "payload IS NOT NULL AND event_type IN ('click', 'purchase')")

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@op("txt_01_tokens", f"SELECT item_id, CAST(unnest(range(len(w))) AS INTEGER) AS position, unnest(w) AS term FROM (SELECT item_id, {_TOK} AS w FROM benchmark)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.postings(table(spark, sf_dir, "benchmark"), "item_id", "text")


@op("txt_02_inverted_index", f"SELECT term, list_sort(list(DISTINCT item_id)) AS ids FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY term")
def inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.index(table(spark, sf_dir, "benchmark"), "item_id", "text")


_D = f"(SELECT doc_id, {_TOK} AS w FROM documents)"


@op("txt_03_boolean_all", f"SELECT doc_id FROM {_D} WHERE list_has_all(w, ['the', 'and', 'on'])")
def all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matching(table(spark, sf_dir, "documents"), "doc_id", "text", "The and on").select("doc_id")


@op("txt_03_boolean_any", f"SELECT doc_id FROM {_D} WHERE list_has_any(w, ['idiot', 'moron'])")
def any_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matching(table(spark, sf_dir, "documents"), "doc_id", "text", "idiot moron", "any").select("doc_id")


@op("txt_04_phrase", f"SELECT doc_id FROM {_D} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matching(table(spark, sf_dir, "documents"), "doc_id", "text", '"of the"').select("doc_id")


@op("txt_05_negative", f"SELECT doc_id FROM {_D} WHERE list_contains(w, 'the') AND NOT list_contains(w, 'ea') AND NOT contains(' ' || array_to_string(w, ' ') || ' ', ' to the ')")
def negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matching(table(spark, sf_dir, "documents"), "doc_id", "text", "the", exclude='ea "to the"').select("doc_id")


def _bm25(terms: list[str], phrases: list[str], where: str) -> str:
    df = ", ".join(f"sum(CASE WHEN list_contains(w, '{t}') THEN 1 ELSE 0 END)::DOUBLE AS df{i}" for i, t in enumerate(terms))
    tf = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE"
    parts = [f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {tf(t)} * 2.2 / ({tf(t)} + 1.2 * (0.25 + 0.75 * len(w) / greatest(1.0, total / n)))" for i, t in enumerate(terms)]
    parts += [f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN {0.25 * len(p.split())} ELSE 0 END" for p in phrases]
    return f"""WITH d AS (SELECT * FROM {_D} WHERE len(w) > 0), c AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE AS total, {df} FROM d)
SELECT doc_id, round(({' + '.join(parts)})::DOUBLE, 6) AS score FROM d, c WHERE {where} ORDER BY score DESC, doc_id"""


_INDEXES: dict[tuple[str, str], fulltext.TextIndex] = {}


def _text_index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    """The text index of a folder's documents, built when first asked for in an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        _INDEXES[at] = fulltext.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", scratch(spark))
    return _INDEXES[at]


@op("txt_06_bm25_scan", _bm25(["ther", "sing"], [], "list_has_any(w, ['ther', 'sing'])") + " LIMIT 20")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "ther sing", 20)


@op("txt_06_bm25", _bm25(["ther", "sing"], [], "list_has_any(w, ['ther', 'sing'])") + " LIMIT 20")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_index(spark, sf_dir).search("ther sing", 20)


@op("txt_07_average_length", f"SELECT round(greatest(1.0, sum(len(w)) / count(*)), 6) AS mean FROM {_D} WHERE len(w) > 0")
def average(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.size(fulltext.tokens("text")).alias("n")).where("n > 0")
    return d.agg(F.round(F.greatest(F.lit(1.0), F.sum("n") / F.count("*")), 6).alias("mean"))


@op("txt_08_search_with_phrase", _bm25(["to", "the", "and"], ["to the"], "contains(' ' || array_to_string(w, ' ') || ' ', ' to the ') AND list_contains(w, 'and') AND NOT list_contains(w, 'idiot')") + " LIMIT 10")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_index(spark, sf_dir).search('"to the" and', 10, "all", "idiot")


@op("hyb_01_hybrid", f"""WITH t AS ({_bm25(['the', 'sing'], [], "list_has_any(w, ['the', 'sing'])")} LIMIT 50)
SELECT doc_id, round(power(list_distance({_E}, {_Q}), 2), 6) AS vector_score, score AS text_score FROM t JOIN embeddings ON vec_id = doc_id ORDER BY vector_score, text_score DESC, doc_id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vecs(spark, sf_dir)
    return hybrid.search(_text_index(spark, sf_dir), e, "the sing", q, 10, 50)


_BOX = "(SELECT vec_id, list_extract({e}, 1) AS x0, list_extract({e}, 1) + 0.05 AS x1, list_extract({e}, 2) AS y0, list_extract({e}, 2) + 0.05 AS y1 FROM embeddings)".format(e=_E)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x0"), (x + 0.05).alias("x1"), y.alias("y0"), (y + 0.05).alias("y1"))


@op("geo_01_box_search", f"SELECT vec_id FROM {_BOX} WHERE x0 <= 0.1 AND x1 >= -0.1 AND y0 <= 0.2 AND y1 >= 0")
def box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where(geo.intersects(["x0", "y0"], ["x1", "y1"], [-0.1, 0.0], [0.1, 0.2])).select("vec_id")


@op("geo_01_box_join", f"SELECT a.vec_id AS a, b.vec_id AS b FROM {_BOX} a JOIN {_BOX} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return geo.box_join(b, b, 0.1).select(F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"))


@op("geo_02_radius", "SELECT event_id FROM (SELECT event_id, event_id % 50 AS lat, event_id % 70 AS lon FROM events) WHERE 2 * 6371000 * asin(sqrt(power(sin(radians(25 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(25)) * power(sin(radians(30 - lon) / 2), 2))) <= 600000")
def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("lat"), (F.col("event_id") % 70).alias("lon"))
    return geo.within(e, "lat", "lon", (25.0, 30.0), 600000.0).select("event_id")


@op("snk_06_vector_upsert", "SELECT vec_id AS id, label + CASE WHEN vec_id % 5 = 0 THEN 100 ELSE 0 END AS label FROM embeddings WHERE vec_id % 7 <> 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    put = e.withColumns({"operation": F.lit("upsert"), "sequence": F.col("id")})
    again = put.where("id % 5 = 0").withColumns({"label": F.col("label") + 100, "sequence": F.col("id") + 1000000})
    gone = put.where("id % 7 = 0").withColumns({"operation": F.lit("delete"), "sequence": F.col("id") + 2000000})
    return vectors.latest(put.unionByName(again).unionByName(gone)).select("id", "label")
