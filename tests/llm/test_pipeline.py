import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sluice.llm import mix, packing, passages, simhash
from sluice.sources.tables import table

CLASHING = ("row", "id", "h", "k", "n", "key", "th", "turn", "spans", "again", "component", "_id", "_times", "_turn", "_spans", "_key", "doc", "sid", "fp", "target", "taken", "y", "score", "piece", "a.b")


def test_stages_in_turn(spark, sf):
    docs = table(spark, sf, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == table(spark, sf, "documents").columns, name
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}


def test_run_agrees_with_itself(spark, sf):
    a = corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()
    b = corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()
    assert len(a) > 0 and sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.fixture(scope="module")
def many(spark, frame, odd, prose):
    """Odd rows, ids that repeat with other texts, near and exact copies, shared passages, and columns that bear inner names."""
    p = prose(70, 90)
    near = prose(71, 100)
    rows = [*odd, (20, p + " " + prose(72, 50), "a"), (20, prose(73, 200), "a"), (21, prose(74, 20) + " " + p, "b"), (21, p.upper() + "\n" + prose(75, 25), "b"),
            (30, near, "c"), (31, near + " more", "c"), (31, prose(76, 80), "c"), (32, near.replace(near.split()[50], "other", 1), None), (33, prose(77, 3), "d")]
    df = frame(rows).drop("_key", "target", "taken")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    return rows, df


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_odd_rows_and_clashing_columns(spark, sf, many, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows, df = many
    out = stage(spark, df, sf)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
    for r in out.collect():
        assert all(r[c] == c for c in CLASHING), name
    assert stage(spark, df.limit(0), sf).count() == 0
    assert stage(spark, df.where("doc_id = 33"), sf).count() <= 2  # the mix takes a document twice at most


def test_the_last_stage_and_the_run_of_odd_rows(spark, sf, many, tmp_path, monkeypatch):
    rows, df = many
    out = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(d for d, _, _ in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf).count() == 0
    for n in (df, df.limit(0)):
        at = f"{tmp_path}/{n is df}"
        n.drop("a.b").write.parquet(f"{at}/documents.parquet")
        table(spark, sf, "labels").write.parquet(f"{at}/labels.parquet")
        assert corpus_pipeline.run(spark, at).count() >= 0


def test_rows_that_share_an_id_are_told_apart(spark, frame, prose):
    """None of two texts of one id goes for the other, in keep_one and drop_repeats, whatever the partitions."""
    a, b, c, d = (prose(80 + i, 120) for i in range(4))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, d, "x"), (7, d, "y")]
    for n in (1, 5):
        got = Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(rows).repartition(n)).collect())
        assert got == Counter([(1, a), (5, b), (7, c), (7, d)])
    p = prose(90, 70)
    rows = [(1, p + " " + prose(91, 30), "x"), (2, prose(92, 40) + " " + p, "x"), (2, prose(93, 200), "x"), (3, prose(94, 60), "x"), (3, prose(95, 10) + " " + p + " " + prose(96, 10), "x")]
    want = Counter([(1, rows[0][1]), (2, prose(92, 40) + " "), (2, rows[2][1]), (3, rows[3][1]), (3, prose(95, 10) + "  " + prose(96, 10))])
    for n in (1, 4):
        assert Counter((r.doc_id, r.text) for r in passages.drop_repeats(frame(rows).repartition(n)).collect()) == want


def test_passages_do_not_depend_on_partitions(spark, frame, prose):
    """The same passages, exact and edited, from 1, 4 and 23 partitions."""
    import random

    r = random.Random(8)
    parts = [prose(200 + i, r.randrange(55, 110)).split() for i in range(10)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(3):
            w += prose(300 + len(rows) * 7 + len(w), r.randrange(10, 40)).split()
            w += [x if r.random() > 0.05 else "edit" for x in r.choice(parts)] if r.random() < 0.6 else []
        rows.append((d, " ".join(w), "a"))
    got = [sorted(map(tuple, passages.repeated_passages(frame(rows).repartition(n)).collect())) for n in (1, 4, 23)]
    assert got[0] and got[0] == got[1] == got[2]


def test_edited_passages_are_found_by_brute_force(spark, frame, prose):
    """Of pairs of passages of 60 to 120 words with one word in twelve or fewer changed, at least 0.9 are found."""
    import random

    r = random.Random(9)
    rows, pairs = [], []
    for i in range(60):
        w = prose(4000 + i, r.randrange(60, 121)).split()
        edited = list(w)
        for j in r.sample(range(len(w)), len(w) // 12):
            edited[j] = "new"
        rows += [(2 * i, " ".join([prose(5000 + i, 30), *w, prose(6000 + i, 30)]), "a"), (2 * i + 1, " ".join([prose(7000 + i, 25), *edited, prose(8000 + i, 25)]), "a")]
        pairs.append((2 * i + 1, 25, 25 + len(w)))
    got = {}
    for x in passages.repeated_passages(frame(rows)).collect():
        if x.source_id == x.doc_id - 1:
            got.setdefault(x.doc_id, set()).update(range(x.start, x.stop))
    hit = sum(len(got.get(d, set()) & set(range(a, z))) >= 0.8 * (z - a) for d, a, z in pairs)
    assert hit >= 54, hit
    assert all(min(s) >= 20 and max(s) < a + (z - a) + 5 for (d, a, z) in pairs if (s := got.get(d)))


def test_mixing_takes_whole_documents(spark, frame, prose):
    rows = [(i % 40, prose(900 + i, 5 + i % 30), "ab"[i % 2]) for i in range(90)]
    got = Counter((r.doc_id, r.text) for r in mix.repeated(frame(rows)).collect())
    want = {}
    for r in mix.mix(frame(rows)).collect():
        want.setdefault((r.doc_id, r.size), []).append(r.taken / r.size)
    for (d, t), n in got.items():
        assert any(abs(x - n) <= 0.5 for x in want[(d, len(re.findall(r"\S+", t)))])
    assert packing.pack(frame(rows)).count() == 90


def test_the_mix_is_that_of_its_sql(spark, sf):
    import duckdb

    from sluice.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    plain = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(QUERIES["op5_mix_sources"](spark, sf).select(*cols).collect()) == plain(c.sql(ORACLE_SQL["op5_mix_sources"]).project(",".join(cols)).fetchall())
