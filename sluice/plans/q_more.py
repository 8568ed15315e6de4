"""Programs, payload indexes, bitmaps, maintenance and the collection's requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import bitmaps, hnsw, maintenance, payload, procs
from sluice.operators.plw import Program, Raised
from sluice.plans.q_search import _ANY, _EV, _payloads
from sluice.plans.registry import op
from sluice.session import scratch
from sluice.sources import files
from sluice.sources.tables import register, table
from sluice.streaming import changefeed


def _row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "bigint", str: "string", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


_LANGUAGE = """
DECLARE
  i INT := 0;
  odd INT DEFAULT 0;
  even INT := 0;
  pairs INT := 0;
BEGIN
  LOOP
    i := i + 1;
    EXIT WHEN i > 9;
    CONTINUE WHEN i = 5;
    IF i % 2 = 1 THEN odd := odd + i; ELSIF i = 8 THEN even := even + 100; ELSE even := even + i; END IF;
  END LOOP;
  <<outer>>
  FOR a IN 1..4 LOOP
    FOR b IN 1..4 LOOP
      CONTINUE outer WHEN b > a;
      EXIT outer WHEN a = 4;
      pairs := pairs + 1;
    END LOOP;
  END LOOP outer;
END;
"""


@op("prc_04_language", "SELECT 1 + 3 + 7 + 9 AS odd, 2 + 4 + 6 + 100 AS even, 6 AS pairs")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Program(spark, _LANGUAGE).run().values
    return spark.createDataFrame([(v["odd"], v["even"], v["pairs"])], "odd int, even int, pairs int")


@op("prc_04a_loops", "SELECT '54321' AS down, 10 AS total, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS nations, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = 2) AS names, FALSE AS found_none")
def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation"])
    v = Program(spark, """
    DECLARE down STRING := ''; total INT := 0; nations INT := 0; names STRING := ''; found_none BOOLEAN := true;
    BEGIN
      FOR i IN REVERSE 1..5 LOOP down := down || i; END LOOP;
      FOREACH x IN ARRAY numbers LOOP total := total + x; END LOOP;
      FOR r IN SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = wanted ORDER BY n_name LOOP
        nations := nations + 1;
        names := names || CASE WHEN nations > 1 THEN ',' ELSE '' END || r.n_name;
      END LOOP;
      FOR r IN SELECT n_name FROM nation WHERE n_regionkey = -1 LOOP nations := 0; END LOOP;
      found_none := found;
    END;""").run(numbers=[1, 2, 3, 4], wanted=2).values
    return _row(spark, down=v["down"], total=v["total"], nations=v["nations"], names=v["names"], found_none=v["found_none"]).withColumn("total", F.col("total").cast("int"))


@op("prc_04d_raise_and_handlers", "SELECT 'P9999' AS state, 'boom 7' AS message, '22012' AS divided, 'P0003' AS many, TRUE AS others, 'careful 1' AS notice")
def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["nation"])
    got = Program(spark, """
    DECLARE state STRING; message STRING; divided STRING; many STRING; others BOOLEAN := false; x INT;
    BEGIN
      RAISE NOTICE 'careful %', 1;
      BEGIN RAISE EXCEPTION 'boom %', 7 USING SQLSTATE = 'P9999';
      EXCEPTION WHEN OTHERS THEN state := SQLSTATE; message := SQLERRM; END;
      BEGIN x := 1 div 0; EXCEPTION WHEN no_data_found OR division_by_zero THEN divided := SQLSTATE; END;
      BEGIN SELECT n_name INTO message2 FROM nation; EXCEPTION WHEN too_many_rows THEN many := SQLSTATE; END;
      BEGIN RAISE EXCEPTION 'again'; EXCEPTION WHEN unique_violation THEN others := false; WHEN OTHERS THEN others := true; END;
    END;""").run()
    v = got.values
    return _row(spark, state=v["state"], message=v["message"], divided=v["divided"], many=v["many"], others=v["others"], notice=got.notices[0])


@op("prc_05_limits", "SELECT '54000' AS statements, '54001' AS depth")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that runs on, and one that calls itself, are stopped."""
    out, calls = {}, {}
    calls["again"] = Program(spark, "BEGIN CALL again(); END;", calls)
    for name, p in (("statements", Program(spark, "BEGIN LOOP NULL_ := 1; END LOOP; END;", most=50)), ("depth", calls["again"])):
        try:
            p.run()
        except Raised as e:
            out[name] = e.state
    return _row(spark, **out)


@op("prc_07_program_cursor", "SELECT (SELECT count(*) FROM region) AS n, (SELECT string_agg(r_name, '' ORDER BY r_regionkey) FROM region) AS names, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS one, '24000' AS closed")
def program_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["region", "nation"])
    v = Program(spark, """
    DECLARE cur CURSOR FOR SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey; rec RECORD; n INT := 0; names STRING := ''; one STRING; closed STRING;
    BEGIN
      OPEN cur;
      LOOP
        FETCH cur INTO rec;
        EXIT WHEN NOT FOUND;
        n := n + 1; names := names || rec.r_name;
      END LOOP;
      CLOSE cur;
      EXECUTE 'SELECT n_name FROM nation WHERE n_nationkey = $1' INTO one USING 3 + 4;
      BEGIN FETCH cur INTO rec; EXCEPTION WHEN OTHERS THEN closed := SQLSTATE; END;
    END;""").run().values
    return _row(spark, n=v["n"], names=v["names"], one=v["one"], closed=v["closed"])


@op("prc_02_call_program", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def call_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that calls another for an OUT value and returns a query's rows."""
    register(spark, sf_dir, ["nation", "region"])
    of = Program(spark, "BEGIN SELECT r_regionkey INTO key FROM region WHERE r_name = wanted; END;")
    name = table(spark, sf_dir, "region").where("r_regionkey = 3").first()["r_name"]
    return Program(spark, "DECLARE key INT; BEGIN CALL region_of(wanted => name); RETURN QUERY SELECT n_name FROM nation WHERE n_regionkey = key; END;", {"region_of": of}).run(name=name).rows


@op("prc_03_python_procedure", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def python_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = procs.Procedures(spark)
    p.create("by_column", lambda s, name, column: table(s, sf_dir, name).groupBy(column).agg(F.count("*").alias("n")))
    return p.call("by_column", column="o_orderpriority", name="orders")


@op("prc_06_triggers_of_every_kind", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal, 'DELETE,INSERT,TRUNCATE,UPDATE' AS seen FROM supplier WHERE s_suppkey <> 3")
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BEFORE trigger mends what is inserted, an INSTEAD OF one keeps a row from being deleted, and each statement's new state is what the next one finds."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    t, seen = procs.Triggers(), []
    t.on("BEFORE", "INSERT", lambda new, old: new.withColumn("s_acctbal", F.greatest("s_acctbal", F.lit(0.0))))
    for e in ("INSERT", "UPDATE", "DELETE", "TRUNCATE"):
        t.on("AFTER", e, lambda new, old, e=e: seen.append(e))
    none = s.limit(0)
    state = t.run("TRUNCATE", s, none, s, lambda target, new, old: none)
    state = t.run("INSERT", state, s, none, lambda target, new, old: target.unionByName(new))
    three = state.where("s_suppkey = 3")
    state = t.run("DELETE", state, none, three, lambda target, new, old: target.join(old.select("s_suppkey"), "s_suppkey", "left_anti"))
    keep = procs.Triggers()
    keep.on("INSTEAD OF", "DELETE", lambda new, old, was=state: was)
    state = keep.run("DELETE", state, none, state.where("s_suppkey = 4"), lambda target, new, old: target.join(old.select("s_suppkey"), "s_suppkey", "left_anti"))
    state = t.run("UPDATE", state, state, state, lambda target, new, old: new)
    return state.withColumn("seen", F.lit(",".join(sorted(seen))))


@op("udf_02_drop_function", "SELECT 42 AS before_drop, TRUE AS gone")
def drop_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    procs.create_function(spark, "twice_of", {"x": "INT"}, "INT", "x * 2")
    before = spark.sql("SELECT twice_of(21)").first()[0]
    procs.drop_function(spark, "twice_of")
    procs.drop_function(spark, "twice_of")
    try:
        spark.sql("SELECT twice_of(21)")
        gone = False
    except AnalysisException:
        gone = True
    return spark.createDataFrame([(before, gone)], "before_drop int, gone boolean")


@op("udf_03_user_aggregate", "SELECT c_nationkey, round(sqrt(avg(c_acctbal * c_acctbal)), 3) AS rms FROM customer GROUP BY c_nationkey")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered aggregate of a user's own, in SQL."""
    register(spark, sf_dir, ["customer"])
    procs.create_aggregate(spark, "root_mean_square", "DOUBLE", lambda x: float((x * x).mean() ** 0.5))
    return spark.sql("SELECT c_nationkey, round(root_mean_square(c_acctbal), 3) AS rms FROM customer GROUP BY c_nationkey")


@op("ddl_08_index_statements", "SELECT * FROM (VALUES ('ix', 'orders', 'btree', 'o_custkey,o_orderdate', 'false', 'sort by o_custkey, o_orderdate'), ('tx', 'documents', 'gin', 'text', 'false', 'inverted index'), ('ux', 'nation', 'btree', 'n_name', 'true', 'sort by n_name')) v(name, \"table\", kind, columns, \"unique\", advice)")
def index_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [maintenance.create_index(spark, s) for s in ("CREATE INDEX ix ON orders (o_custkey, o_orderdate DESC)", "create index tx on documents using gin (text)", "CREATE UNIQUE INDEX IF NOT EXISTS ux ON nation USING BTREE (n_name);")]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


@op("ddl_11_vacuum", "SELECT c_custkey, c_name, 1 AS n_files FROM customer")
def vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, to = scratch(spark), scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(7).write.parquet(at)
    out = maintenance.vacuum(spark, at, to, sort=["c_custkey"])
    return out.withColumn("n_files", F.lit(len(out.inputFiles())))


@op("stm_02_streamability", "SELECT * FROM (VALUES ('filter', ''), ('window', 'window function'), ('right join', 'right join'), ('sorted aggregate', 'sort of an aggregate'), ('joined aggregate', 'aggregate of a join')) v(query, reasons)")
def streamability(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders", "customer"])
    asked = {
        "filter": "SELECT o_orderkey FROM orders WHERE o_totalprice > 10",
        "window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders",
        "right join": "SELECT o_orderkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
        "sorted aggregate": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n",
        "joined aggregate": "SELECT c_name, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name",
    }
    return spark.createDataFrame([(k, ",".join(maintenance.blockers(spark.sql(q)))) for k, q in asked.items()], "query string, reasons string")


@op("stm_03_snapshot_read", "SELECT count(*) AS n, (SELECT count(*) * 2 FROM nation) AS later FROM nation")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read that has begun doesn't see rows that are appended."""
    at, n = scratch(spark), table(spark, sf_dir, "nation")
    n.write.parquet(at)
    before = spark.read.parquet(at)
    files.append(n, at)
    return _row(spark, n=before.count(), later=spark.read.parquet(at).count())


@op("stm_06_change_events", "SELECT 'id: ' || event_id || chr(10) || 'event: ' || CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'upsert' END || chr(10) || 'data: {\"id\":' || user_id || '}' || chr(10) || chr(10) AS message FROM events WHERE event_id BETWEEN 10 AND 30")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as server-sent events, for whatever serves them."""
    e = table(spark, sf_dir, "events").where("event_id BETWEEN 10 AND 30")
    kind = F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert")
    return changefeed.messages(e.select(F.col("event_id").alias("sequence"), kind.alias("operation"), F.col("user_id").alias("id")), ["id"])


@op("stm_08_late_rows_of_a_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) GROUP BY ALL")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that gets recent rows first, then rows of the first day, which the watermark leaves out, then one far on that closes the windows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    day = F.lit(first) + F.expr("INTERVAL 1 DAY")
    far = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("event_type"), (F.lit(last) + F.expr("INTERVAL 9 DAYS")).alias("ts"))
    feed, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for part in (e.where(F.col("ts") >= day), e.where(F.col("ts") < day), far):
        part.coalesce(1).write.mode("append").parquet(feed)
        s = spark.readStream.schema(e.schema).parquet(feed)
        changefeed.windowed_counts(s).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(out).where("event_type != 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@op("stm_09_wait_for_index", "SELECT count(*) AS n FROM embeddings")
def wait_for_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexing as a job of its own that a caller waits for, then finds all rows in it."""
    from concurrent.futures import ThreadPoolExecutor

    e, at = table(spark, sf_dir, "embeddings"), scratch(spark)
    with ThreadPoolExecutor(1) as pool:
        index = pool.submit(hnsw.Hnsw.build, e.limit(200), at, shard_rows=100).result()
    return index.insert(e, "1", 512)._ids().agg(F.count_distinct("id").alias("n"))


_MUST = {"must": [_ANY, {"key": "n", "range": {"gte": 50, "lt": 900}}]}


@op("pix_01_payload_index", f"SELECT event_id FROM {_EV} WHERE payload IS NOT NULL AND event_type = 'click' AND event_id >= 50 AND event_id < 900 AND event_id % 60 <> 10")
def payload_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the index, and what it can't tell judged on the rows."""
    p = _payloads(spark, sf_dir)
    index = payload.PayloadIndex.build(p, "event_id", "payload", ["type", "n", "odd"], scratch(spark))
    return index.search(p, "payload", _MUST | {"must_not": [{"key": "at.lat", "match": {"value": 10}}]}).select("event_id")


@op("pix_01_payload_candidates", f"SELECT event_id FROM {_EV} WHERE payload IS NOT NULL AND event_type IN ('click', 'view') AND event_id % 2 = 1 AND event_id = 33")
def payload_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _payloads(spark, sf_dir)
    index = payload.PayloadIndex.build(p, "event_id", "payload", ["type", "n", "odd"], scratch(spark))
    return index.candidates({"must": [{"key": "type", "full_text": {"query": "click VIEW", "mode": "any"}}, {"key": "odd", "match": {"value": True}}, {"key": "n", "match": {"value": 33}}]})


@op("bmp_01_bitmaps", """
WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O')
SELECT 'and' AS op, id FROM a WHERE id IN (SELECT id FROM b) AND id < 500 UNION ALL SELECT 'andnot', id FROM a WHERE id NOT IN (SELECT id FROM b) AND id < 500
UNION ALL SELECT 'n_or', (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b))""")
def bitmap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bitmaps.build(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_orderkey")
    b = bitmaps.build(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "o_orderkey")
    both, rest = (bitmaps.ids(x).where("id < 500") for x in (bitmaps.intersect(a, b), bitmaps.minus(a, b)))
    n = bitmaps.count(bitmaps.union(a, b)).select(F.lit("n_or").alias("op"), F.col("n").alias("id"))
    return both.select(F.lit("and").alias("op"), "id").union(rest.select(F.lit("andnot").alias("op"), "id")).union(n)


@op("api_01_requests", "SELECT * FROM (VALUES ('count', 9::BIGINT), ('get', 1::BIGINT), ('search', 3::BIGINT), ('after delete', 7::BIGINT)) v(request, rows)")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints' requests as functions of a collection: put, get, search, delete."""
    from sluice.operators import api

    e = table(spark, sf_dir, "embeddings").where("vec_id < 10").select(F.col("vec_id").alias("id"), "embedding", F.lit(json.dumps({"kind": "x"})).alias("payload"))
    c = api.Service(spark)
    c.request("PUT", "/collections/c", {"rows": e.where("id < 6")})
    c.request("POST", "/collections/c/points", {"rows": e.where("id BETWEEN 4 AND 8")})
    n = {"count": c.request("GET", "/collections/c/points").count(), "get": c.request("GET", "/collections/c/points/5").count()}
    q = [float(x) for x in e.where("id = 0").first()["embedding"]]
    n["search"] = c.request("POST", "/collections/c/search", {"vector": q, "top": 3, "filter": {"must": [{"key": "kind", "match": {"value": "x"}}]}}).count()
    c.request("DELETE", "/collections/c/points", {"ids": [1, 2]})
    n["after delete"] = c.request("GET", "/collections/c/points").count()
    return spark.createDataFrame(list(n.items()), "request string, rows bigint")


@op("src_19_sqlite_import", "SELECT n_nationkey, n_name, n_regionkey::DOUBLE / 2 AS half FROM nation")
def sqlite_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import sqlite3
    import tempfile

    at = os.path.join(tempfile.mkdtemp(prefix="sluice-"), "x.db")  # a file that is there already, as an importer finds it
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, half REAL)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r[0], r[1], r[2] / 2) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return files.import_sqlite(spark, at, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType))


@op("src_20_jdbc_import", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 400")
def jdbc_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read over JDBC from a database that is there already, as an importer finds it (the embedded one that Spark brings), in ranges of the key."""
    o = table(spark, sf_dir, "orders").where("o_orderkey < 400").select("o_orderkey", "o_totalprice")
    url, driver = files.pack_derby(spark, "orders_in", 'CREATE TABLE orders_in ("o_orderkey" BIGINT, "o_totalprice" DOUBLE)', [tuple(r) for r in o.collect()])
    return files.import_jdbc(spark, url, "orders_in", "o_orderkey", (0, 400), 4, driver=driver)
