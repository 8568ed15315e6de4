"""Small cases of helpers: dialect rewriting, JSON rewriting, filters, DML corner cases, imports and procedures."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from sluice.functions import json_ops, scalar
from sluice.operators import dml, eager, filters, fulltext, geo, procs, recursive, schema, subqueries, vectors, windows
from sluice.plans import dialect
from sluice.sources import files


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rewrites_leave_strings_alone():
    assert dialect.rewrite("SELECT TOP 3 a FROM t WHERE b = 'TOP 5 @x'") == "SELECT a FROM t WHERE b = 'TOP 5 @x' LIMIT 3"
    assert "LIMIT 4 OFFSET 2" in dialect.rewrite("SELECT a FROM t ORDER BY a OFFSET 2 ROWS FETCH NEXT 4 ROWS ONLY")
    assert dialect.rewrite("SELECT p ->> 'a' FROM t WHERE id = @id") == "SELECT get_json_object(p, '$.a') FROM t WHERE id = :id"
    assert "COLLATE de" in dialect.rewrite('SELECT a COLLATE "de-DE-x-icu" FROM t')


def test_splits_scripts():
    assert dialect.split("SELECT 1; SELECT ';'; CREATE FUNCTION f() AS $$ a; b $$;") == ["SELECT 1", "SELECT ';'", "CREATE FUNCTION f() AS $$ a; b $$"]


def test_quantified_sql(spark):
    spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, x int").createOrReplaceTempView("qt")
    ids = lambda q: [r[0] for r in dialect.sql(spark, q).collect()]
    assert ids("SELECT id FROM qt WHERE x > ALL (SELECT x FROM qt WHERE id > 10) ORDER BY id") == [1, 2, 3]
    assert ids("SELECT id FROM qt WHERE x > ANY (SELECT x FROM qt WHERE id > 10)") == []
    assert ids("SELECT id FROM qt WHERE x >= ALL (SELECT x FROM qt)") == []
    assert ids("SELECT id FROM qt WHERE x = ANY (SELECT 9)") == [3]
    assert ids("SELECT id FROM qt WHERE x <> ALL (SELECT 9) ORDER BY id") == [1]


def test_quantified_frames(spark):
    t = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    none = t.where("x > 100")
    assert subqueries.compare_all(t, "x", ">", none, "x").count() == 3
    assert subqueries.compare_any(t, "x", ">", none, "x").count() == 0
    assert subqueries.compare_all(t, "x", ">", t, "x").count() == 0
    assert got(subqueries.compare_any(t, "x", ">", t, "x")) == [(5,)]
    assert got(subqueries.compare_any(t, "x", "<>", t, "x")) == [(1,), (5,)]
    assert subqueries.compare_all(t, "x", "=", none, "x").count() == 3
    assert got(subqueries.compare_all(t, "x", "<>", t.where("x = 1"), "x")) == [(5,)]


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.substring(F.lit("hello"), F.lit(0), F.lit(2)), scalar.length0(F.lit(None).cast("string")), scalar.charindex(F.lit("L"), F.lit("hello"), 4),
        scalar.round_even(F.lit(2.5)), scalar.trim_space(F.lit("\t a \n")), scalar.dateadd("WEEK", F.lit(1), F.lit("2024-01-01").cast("timestamp_ntz")), scalar.divide(1, 0)).first()
    assert tuple(r) == ("he", 0, 4, 2.0, "a", None, None)
    assert scalar.icu_collation("de-DE-x-icu") == "de"


def test_json(spark):
    d = spark.createDataFrame([('{"a":[1,{"b":null}],"c":1.0}',), ("broken",), (None,)], "d string")
    one = lambda c: [r[0] for r in d.select(c).collect()]
    assert one(json_ops.strip_nulls("d")) == ['{"a":[1,{}],"c":1.0}', None, None]
    assert one(json_ops.set_path("d", "$.x.y[1]", "2"))[0] == '{"a":[1,{"b":null}],"c":1.0,"x":{"y":[null,2]}}'
    assert one(json_ops.contains_json("d", '{"a":[{"b":null}]}')) == [True, False, False]
    assert one(json_ops.path_query("d", "$.a[*]")) == ["1", None, None]
    assert one(json_ops.has_all("d", "a", "c")) == [True, False, False]


def test_filters(spark):
    p = spark.createDataFrame([(1, '{"c":"pdf","n":3}'), (2, '{"c":"PDF","n":3.5}'), (3, None)], "id int, p string")
    ids = lambda f: [r.id for r in p.where(filters.column("p", f)).collect()]
    assert ids({}) == [1, 2, 3]
    assert ids({"must": [{"key": "c", "match": {"value": "pdf"}}]}) == [1]
    assert ids({"must": [{"key": "n", "range": {"gte": 3}}]}) == [1]
    assert ids({"must": [{"key": "n", "match": {"value": 3.5}}]}) == [2]
    for bad in ({"any": []}, {"must": [{"key": "a"}]}, {"must": [{"key": "a", "match": {"value": 1}, "range": {}}]}):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)


def test_merge_null_and_unmatched_keys(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert got(dml.merge(t, s, ["k"], {"v": F.col("s.v")})) == sorted([(1, "b"), (2, "c"), (None, "n"), (None, "d")], key=str)
    assert got(dml.upsert(t, s, ["k"])) == sorted([(1, "b"), (2, "c"), (None, "n"), (None, "d")], key=str)


def test_constraints(spark):
    t = schema.Table("t", {"id": "INT", "age": "INT"}, ["id"], checks={"adult": "age >= 0"})
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "id int, age int")
    assert {k: v.count() for k, v in t.violations(df).items()} == {"23505 primary key": 1, "23502 not null": 0, "23514 adult": 1}
    with pytest.raises(dml.ConstraintViolation) as e:
        t.validate(df)
    assert e.value.state == "23505"
    with pytest.raises(dml.ConstraintViolation):
        dml.delete_parent(df, F.col("id") == 2, [(df, {"id": "id"}, "RESTRICT")])
    assert schema.spark_type("VARCHAR(30)") == "string" and schema.spark_type("decimal(10,2)") == "decimal(10,2)"


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    step = lambda r: r.alias("r").join(edges.alias("e"), F.col("r.b") == F.col("e.a")).select("r.a", "e.b")
    assert recursive.fixpoint(edges, step).count() == 9
    with pytest.raises(RuntimeError):
        recursive.fixpoint(spark.range(1), lambda r: r.select(F.col("id") + 1), 3)


def test_procedures(spark):
    p = procs.Procedures(spark)
    p.create("f", lambda s, a, b=2: a + b)
    assert p.call("F", 1) == 3 and p.call("f", a=1, b=5) == 6
    with pytest.raises(procs.ProcedureError):
        p.create("f", lambda s, a, b: 0)
    p.drop("f")
    with pytest.raises(procs.ProcedureError):
        p.call("f", 1)
    with pytest.raises(procs.ProcedureError) as e:
        procs.select_into(spark.range(2))
    assert e.value.state == "P0003"
    assert procs.select_into(spark.range(0)) is None


def test_sqlite_import(spark, tmp_path):
    at = str(tmp_path / "x.db")
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, "a", 0.5), (2, None, None)])
    assert got(files.import_sqlite(spark, at, "t")) == [(1, "a", 0.5), (2, None, None)]


def test_rows_are_streamed(spark):
    df = spark.range(1000).repartition(7)
    rows = files.stream_rows(df)
    assert 0 <= next(rows).id < 1000 and len(list(rows)) == 999


def test_global_row_number_of_mixed_directions(spark):
    from sluice.operators import sorting

    d = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(60)], "id int, v int").repartition(6)
    r = sorting.global_row_number(d, [F.col("v").desc_nulls_first(), F.col("id").asc()], "place").orderBy("place").collect()
    want = sorted(((i, None if i % 5 == 0 else i % 3) for i in range(60)), key=lambda x: (x[1] is not None, -(x[1] or 0), x[0]))
    assert [(x.id, x.v) for x in r] == want and [x.place for x in r] == list(range(1, 61))


def test_programs(spark):
    from sluice.operators.plw import Program, Raised

    run = lambda text, **v: Program(spark, text).run(**v)
    assert run("BEGIN RETURN a + 1; END;", a=2).value == 3
    assert run("DECLARE x INT := 1; BEGIN WHILE x < 20 LOOP x := x * 2; END LOOP; END").values["x"] == 32
    assert run("DECLARE s STRING; BEGIN s := 'it''s; END LOOP'; -- not; this\n END;").values["s"] == "it's; END LOOP"
    with pytest.raises(Raised) as e:
        run("BEGIN RAISE EXCEPTION 'no'; END;")
    assert (e.value.state, e.value.message) == ("P0001", "no")
    for bad in ("BEGIN x := 1 END;", "BEGIN LOOP END;", "BEGIN EXIT; END;", "BEGIN IF true THEN END;"):
        with pytest.raises(Raised) as e:
            run(bad)
        assert e.value.state == "42601"
    with pytest.raises(Raised) as e:
        Program(spark, "BEGIN CALL nobody(); END;").run()
    assert e.value.state == "42883"


def test_graph_index():
    import numpy as np

    from sluice.operators.hnsw import Graph

    x = np.random.default_rng(1).normal(size=(600, 16))
    g, ids = Graph.load(Graph(x, 8, 60).dump(np.arange(600)))
    hit = 0
    for q in range(0, 600, 20):
        d = ((x - x[q]) ** 2).sum(1)
        hit += len({i for _, i in g.search(x[q], 10, 60)} & set(np.argsort(d)[:10].tolist()))
    assert hit / 300 > 0.95
    few = np.zeros(600, bool)
    few[[3, 500]] = True
    assert {i for _, i in g.search(x[0], 5, 20, few)} == {3, 500} and Graph(x[:0]).search(x[0], 3) == []
    assert [i for _, i in Graph(x[:1]).search(x[0], 3)] == [0]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in v.select(vectors.cosine("embedding", [1.0, 0.0]), vectors.l2("embedding", [0.0, 0.0])).collect()] == [(0.0, 0.0), (0.6, 5.0)]
    assert [list(r[0]) for r in v.select(vectors.normalize("embedding")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    with pytest.raises(Exception, match="vector size"):
        vectors.checked(v, "embedding", 3).collect()


def test_text(spark):
    d = spark.createDataFrame([(1, "Red fox, blue dog"), (2, "blue red fox"), (3, None)], "id int, t string")
    ids = lambda *a, **k: [r.id for r in fulltext.matching(d, "id", "t", *a, **k).collect()]
    assert ids('"red fox" blue') == [1, 2] and ids('"fox blue"') == [1] and ids("red", exclude='"blue dog"') == [2] and ids("") == []


def test_geo_and_include(spark):
    assert abs(spark.range(1).select(geo.haversine(0, 0, 0, 1)).first()[0] - 111194.93) < 0.01
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5), (1, 3)], "pid int, v int")
    assert [(r.id, [x.v for x in r.cs]) for r in eager.include(p, c, "id", "pid", "cs", order=["v"], take=1).orderBy("id").collect()] == [(1, [3]), (2, [])]


def test_groups_frame(spark):
    d = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "id int, v int").withColumn("p", F.lit(1))
    assert [r.n for r in windows.groups_frame(d, ["p"], ["v"], -1, 0, n=(F.count, F.lit(1))).orderBy("id").collect()] == [1, 3, 3, 3]


def test_filter_reaches_the_scan(spark, sf):
    from sluice.sources.tables import table

    plan = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
