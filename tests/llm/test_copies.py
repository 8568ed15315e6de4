import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import common, graph, passages, simhash


def groups(fps, radius):
    par = list(range(len(fps)))

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) % (1 << 64)).count("1") <= radius:
                par[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_components_of_chains_cycles_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    r.shuffle(edges)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_in_one_task_are_those_of_stars(spark, monkeypatch):
    r = random.Random(5)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(None, 5), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    one = sorted(map(tuple, graph.components(df).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert one == sorted(map(tuple, graph.components(df).collect())) and len(one) > 500
    assert jobs <= 10, jobs  # what the driver holds grows with the queries


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(2)
    for radius in (2, 4):
        ms = [m % (1 << 64) for m in simhash.masks(radius)]
        for _ in range(3000):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(m & d == 0 for m in ms)


def test_links_are_those_of_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base) | {0}
    for b in base[:12]:  # chains and dense clusters
        x = b
        for _ in range(15):
            x ^= sum(1 << k for k in r.sample(range(64), r.randrange(1, 5)))
            fps.add(x)
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10, 20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x.node: x.component for x in simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 4).collect()}
    want = groups(signed, 4)
    mine = [got.get(f, f) for f in signed]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_near_duplicates_of_odd_rows(spark, frame, odd):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(odd)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (None, 1)} <= got
    assert simhash.near_duplicates(frame(odd)).count() == len(odd)
    assert simhash.near_duplicates(frame([])).count() == 0
    kept = simhash.keep_one(frame(odd))
    assert kept.columns == frame(odd).columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 7, 8]


def test_passages_are_found_and_cut_once(spark, frame, prose):
    p, q = prose(50, 70), prose(51, 80)
    edited = " ".join("XX" if i % 13 == 5 else w for i, w in enumerate(q.split()))
    rows = [(1, prose(1, 40) + " " + p + " " + prose(2, 40), "a"), (2, prose(3, 55) + "\n" + p.upper(), "a"), (3, p + " " + prose(4, 30), "a"), (4, prose(5, 90), "a"),
            (5, q, "b"), (6, prose(6, 20) + " " + edited + " " + prose(7, 20), "b"), (7, None, "b"), (8, "", None), (None, p, "c"), (9, "same " * 300, "c"), (10, "same " * 300, "c")]
    got = {(r.doc_id, r.start, r.stop, r.source_id) for r in passages.repeated_passages(frame(rows)).collect()}
    assert (2, 55, 125, 1) in got and {(d, s) for d, _, _, s in got} >= {(3, 1), (6, 5), (10, 9)}
    assert {d for d, *_ in got} == {2, 3, 6, 10}
    assert [(a, z) for d, a, z, s in got if d == 6] == [(20, 100)]
    out = passages.drop_repeats(frame(rows))
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert out.columns == frame(rows).columns and out.count() == len(rows)
    assert text[1] == rows[0][1] and text[2] == prose(3, 55) + "\n" and text[3] == " " + prose(4, 30) and text[4] == rows[3][1] and text[10].strip() == ""
    assert passages.repeated_passages(frame([])).count() == 0


def test_exact_windows_are_covered(spark, frame, prose):
    """Every 50-word window that an earlier document has lies in passages, but for words that are next to one by chance."""
    r = random.Random(4)
    parts = [prose(100 + i, r.randrange(50, 120)) for i in range(6)]
    rows = [(d, " ".join(r.choice([prose(1000 * d + k, r.randrange(5, 60)), r.choice(parts)]) for k in range(5)), "a") for d in range(40)]
    spans = {}
    for x in passages.repeated_passages(frame(rows)).collect():
        spans.setdefault(x.doc_id, set()).update(range(x.start, x.stop))
    first = {}
    for d, t, _ in rows:
        w = t.split()
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            if first.setdefault(g, d) != d:
                assert len(set(range(i, i + 50)) - spans.get(d, set())) <= 2, (d, i)


def test_exact_repeats_with_common_lines_inside(spark, frame, prose):
    """The first document that holds a repeat is found whatever its seeds point to, in one batch or several."""
    parts = [prose(300 + i, 80).split() for i in range(12)]
    rows = []
    for i, p in enumerate(parts):
        rows.append((10 * i, prose(400 + i, 30) + " " + " ".join(p) + " " + prose(500 + i, 30), "a"))
        rows += [(10 * i + j, prose(600 + 10 * i + j, 25) + " " + " ".join(p[20:60]) + " " + prose(800 + 10 * i + j, 25), "a") for j in (-3, -2, 1, 2, 3)]
        rows += [(1000 + i, prose(1000 + i, 20) + " " + " ".join(p), "b")]
    for batch in (3, 10_000):
        old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = passages.repeated_passages(frame(rows)).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        for i in range(12):
            assert any(r.doc_id == 1000 + i and r.source_id == 10 * i and r.start <= 20 and r.stop >= 100 for r in got), (batch, i)


def test_one_is_kept_of_each_group_of_similar_shingles(spark, frame, prose):
    """Rows are those of brute force at a shingle similarity of 0.8, with copies from 0.7 to 0.97 of each text."""
    r = random.Random(11)
    texts = [prose(5000 + i, 200).split() for i in range(30)]
    rows = []
    for t in texts:
        for edits in (0, 1, 2, 3, 4, 5, 6, 8):
            w = list(t)
            for i in r.sample(range(len(w)), edits):
                w[i] = f"new{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(w), "a"))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    par = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = par[i], par[j]
                par = [min(a, b) if p in (a, b) else p for p in par]
    want = {i for i in range(len(rows)) if par[i] == i}
    assert len(want) < len(rows)
    assert {x.doc_id for x in simhash.keep_one(frame(rows)).collect()} == want


def test_pairs_that_no_pivot_leads_to_are_found(frame, prose, monkeypatch):
    """Whatever pivots miss, all pairs of a group that are in different components are compared."""
    pivots = simhash._pivots
    monkeypatch.setattr(simhash, "_pivots", lambda *a: pivots(*a).where("a % 7 = 0"))  # most links are not found by them
    r, rows = random.Random(11), []
    for base in range(8):
        words = prose(900 + base, 120).split()
        for k in range(20):
            mine = list(words)
            for _ in range(r.randrange(0, 4)):
                mine[r.randrange(len(mine))] = f"edit{r.random()}"
            rows.append((base * 100 + k, " ".join(mine), "s"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, _ in rows]
    par = list(range(len(rows)))

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                par[max(a, b)] = min(a, b)
    assert {x.doc_id for x in simhash.keep_one(frame(rows)).collect()} == {rows[i][0] for i in range(len(rows)) if root(i) == i}


def by_all_pairs(texts, min_words=passages.MIN_WORDS):
    """(doc, words) of the passages that chains of all seeds make of all pairs of texts."""
    k = passages.K
    hashes = [common.words(pa.array([t]), lower=True).hashes().view(np.int64) for t in texts]
    own = []
    for t in texts:
        at = {}
        _, pos, g, _ = passages.seeds(pa.array([t]), k, passages.WINDOW)
        for x, v in sorted(zip(pos.tolist(), g.tolist())):
            at.setdefault(v, []).append(x)
        own.append(at)
    for d in range(len(texts)):
        for p in range(d):
            met = sorted((x, own[p][v][0]) for v in own[d].keys() & own[p].keys() for x in own[d][v])
            if len(met) < 2:
                continue
            rx, ry, rn = passages.runs(*np.array(met).T, k, passages.WINDOW)
            for c in passages.chains(rx, ry, rn, k):
                x, y, n = rx[c], ry[c], rn[c]
                if min(x[-1] + n[-1] - x[0], y[-1] + n[-1] - y[0]) < min_words - passages.PAD or 3 * n.sum() < min_words:
                    continue
                a, b = ([h[i:j].tolist() for i, j in passages.gap_spans(s, n)] for h, s in ((hashes[d], x), (hashes[p], y)))
                if found := passages.align(x, y, n, a, b, min_words, passages.SIMILARITY):
                    yield d, set(range(found[0], found[1]))


def test_passages_are_found_wherever_their_seeds_lead(spark, frame, prose):
    """Edited passages, pieces of which many other documents have, too short to be passages: all that pairs by brute force cover is covered."""
    r, texts = random.Random(12), []
    edited = lambda w: [x if r.random() > 0.06 else f"new{r.randrange(10**6)}" for x in w]
    parts = [prose(2000 + i, 90).split() for i in range(6)]
    for i, p in enumerate(parts):
        for j in range(12):
            at = 30 * (j % 3)
            texts.append(" ".join([prose(2100 + 20 * i + j, 20), *p[at : at + 30], prose(2400 + 20 * i + j, 20)]))
    first = len(texts)
    texts += [" ".join([prose(3000 + n, 20), *edited(p), prose(3100 + n, 20), *edited(r.choice(parts)), prose(3200 + n, 20)]) for n, p in enumerate(parts * 4)]
    got = {}
    for x in passages.repeated_passages(frame([(i, t, "a") for i, t in enumerate(texts)])).collect():
        got.setdefault(x.doc_id, set()).update(range(x.start, x.stop))
    want = list(by_all_pairs(texts))
    assert len({d for d, _ in want}) > 15 and min(got) >= first
    for d, w in want:
        assert len(w - got.get(d, set())) <= 5, (d, len(w), len(w - got.get(d, set())))  # words beyond the outer seeds


def test_lists_of_seeds_meet_as_their_rows_do():
    """A seed meets the first place where the other document has it, in each pair of documents by itself."""
    rng = np.random.default_rng(5)
    rows = [(d, p, rng.integers(0, 9, rng.integers(0, 7)).tolist(), rng.integers(0, 9, rng.integers(0, 7)).tolist()) for d in range(9) for p in range(d)]
    rows = [(d, p, g, rng.permutation(len(g)).tolist(), h, rng.permutation(len(h)).tolist()) for d, p, g, h in rows]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), longs, ints, longs, ints))], ["doc", "pdoc", "g", "x", "pg", "y"])
    want = [(d, p, x, min(y for v, y in zip(h, ys) if v == u)) for d, p, g, xs, h, ys in rows for u, x in zip(g, xs) if u in h]
    assert list(zip(*(c.tolist() for c in passages._met(b)))) == sorted(want)


def test_near_copies_that_the_first_one_covers_meet_no_others(spark, frame, prose, monkeypatch):
    """Where the first document with a pair of seeds covers the words between, the others that have it aren't matched."""
    rng = np.random.default_rng(11)
    base = prose(11, 80).split()
    parts = [" ".join([prose(1000 + 50 * at + i, 20), *base[at : at + 14], prose(9000 + 50 * at + i, 20)]) for at in range(0, 67, 3) for i in range(15)]
    texts = parts + [" ".join([*base[:39], f"x{i}", *base[40:]]) for i in range(20)]
    asked, every = [], []
    chains, others = passages.other_chains, passages._others

    def counted(shared, pairs, *a):
        asked.append(pairs.count())
        return chains(shared, pairs, *a)

    def before(docs, shared, spans, n, similarity, k, window):
        held = passages.held_pairs(shared, k, n)
        every.append(passages.open_pairs(shared, spans, k, n).join(held, "pair").where("pdoc < doc").select("doc", "pdoc").distinct().count())
        return others(docs, shared, spans, n, similarity, k, window)

    monkeypatch.setattr(passages, "other_chains", counted)
    monkeypatch.setattr(passages, "_others", before)
    assert passages.repeated_passages(frame([(i, t, "a") for i, t in enumerate(texts)])).count()
    assert sum(asked) < 40 and every[0] > 100, (asked, every)


def test_parts_cover_all_that_any_part_of_a_chain_does():
    """The few passages of a chain hold each word that some part of it makes a passage of, and each is one by itself."""
    rng, more = np.random.default_rng(3), 0
    for _ in range(300):
        m = int(rng.integers(1, 12))
        ls, wide = rng.integers(5, 40, m), rng.integers(0, 26, (m + 1, 2))
        xs, ys = (20 + np.cumsum(wide[:m, i]) + np.cumsum(ls) - ls for i in (0, 1))
        a, b = ([rng.integers(0, 4, n).tolist() for n in wide[:, i]] for i in (0, 1))
        got = passages.parts(xs, ys, ls, a, b, 50, 0.8)
        want, best = set(), passages.align(xs, ys, ls, a, b, 50, 0.8)
        for i in range(m):
            for j in range(i, m):
                one = passages.align(xs[i : j + 1], ys[i : j + 1], ls[i : j + 1], a[i : j + 2], b[i : j + 2], 50, 0.8)
                want |= set(range(*one[:2])) if one else set()
        assert set().union(*(range(p[0], p[1]) for p in got)) == want
        assert all(min(p[1] - p[0], p[3] - p[2]) >= 50 and 2 * p[4] >= 0.8 * (p[1] - p[0] + p[3] - p[2]) - 1e-6 for p in got)
        assert len({p[0] for p in got}) == len(got) and (best is None or set(range(*best[:2])) <= want)
        more += best is not None and set(range(*best[:2])) != want
    assert more > 5


def test_both_near_passages_of_a_chain_are_found(frame, prose):
    """Two near passages, a few equal words between them: too little for one passage of all."""
    a, b, few = prose(5001, 56).split(), prose(5002, 60).split(), prose(5003, 12)
    text = lambda i, a, b: " ".join([*a, prose(5010 + i, 22), few, prose(5020 + i, 22), *b])
    rows = [(1, text(1, a, b), "s"), (2, text(2, [*a[:28], "x", *a[29:]], [*b[:30], "y", *b[31:]]), "s")]
    got = {(x.doc_id, x.start, x.stop, x.source_id, x.source_start, x.source_stop, x.n_same) for x in passages.repeated_passages(frame(rows)).collect()}
    assert {(2, 0, 56, 1, 0, 56, 55), (2, 112, 172, 1, 112, 172, 59)} == got


def test_thinned_runs_of_a_seed_have_the_same_pairs():
    rng = np.random.default_rng(8)
    for lo, hi in ((12, 82), (0, 46)):
        step = 55 if hi == 82 else 31
        for _ in range(20):
            g = np.repeat(rng.integers(0, 6, 12), rng.integers(1, 200, 12))
            x = np.arange(len(g))
            keep = rng.random(len(g)) < 0.98
            g, x, doc = g[keep], x[keep], np.sort(rng.integers(0, 2, int(keep.sum())))
            few = passages.thinned(x, doc, g, step)

            def pairs(at):
                i, j = passages.seed_pairs(x[at], doc[at], lo, hi)
                return {*zip(g[at][i].tolist(), g[at][j].tolist(), doc[at][i].tolist())}

            assert pairs(few) == pairs(np.arange(len(g))) and len(few) < len(g) / 3
    assert len(passages.thinned(*[np.zeros(0, np.int64)] * 3, 5)) == 0


def test_only_seeds_that_an_earlier_document_has_are_paired(spark, frame, prose):
    base = prose(6001, 200).split()
    docs = [(0, " ".join(base)), (1, prose(6002, 90)), (2, " ".join([*base[:100], "x", *base[101:]])), (3, " ".join([*base[:50], prose(6003, 60)]))]
    shared = passages.shared_seeds(spark.createDataFrame(docs, "doc bigint, text string"), passages.K, passages.WINDOW).localCheckpoint()
    none = spark.createDataFrame([], "doc bigint, start int, stop int")
    rows = passages.open_pairs(shared, none, passages.K, passages.MIN_WORDS).collect()
    late = {(x.doc, x.g) for x in shared.where("first.doc < doc").collect()}
    assert {x.doc for x in rows} == {2, 3} and all((x.doc, x.a) in late and (x.doc, x.b) in late for x in rows)


def test_documents_too_short_for_a_passage_meet_nobody(spark, monkeypatch):
    met, real = [], passages.other_chains

    def seen(shared, pairs, *args):
        met.extend(tuple(r) for r in pairs.select("doc", "pdoc").collect())
        return real(shared, pairs, *args)

    monkeypatch.setattr(passages, "other_chains", seen)
    line, long = " ".join(f"l{i}" for i in range(40)), " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{line} u{i}") for i in range(1, 8)] + [(i, f"{long} v{i}") for i in (8, 9)]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert not met
    assert {(r.doc_id, r.start, r.stop, r.source_id) for r in found} == {(9, 0, 60, 8)}
