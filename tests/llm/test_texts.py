import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import katz, mix, packing, quality, rules, toxicity


def test_mix_by_hand(spark, frame):
    rows = [(1, "a b c d", "x"), (2, "a b", "x"), (3, "a b c", "y"), (4, None, "z"), (5, "", None), (6, "w", None), (7, "p q", "y"), (7, "p q", "y")]
    got = {(r.doc_id, r.size, r.source_size): (r.target, r.taken) for r in mix.mix(frame(rows)).collect()}
    total, sizes = 14, {"x": 6, "y": 7, "z": 0, None: 1}
    t = {s: [v[0] for (d, n, z), v in got.items() if (d, s) in {(a, c) for a, _, c in rows}][0] for s in sizes}
    # weights 3, 1, 2, 3 in order x, y, z, null; null and x stop at twice their words, y gets what is left and stops, too
    assert t["z"] == 0 and t[None] == 2 and abs(sum(t.values()) - 1.5 * total) < 1e-9 and t["x"] == 12 and abs(t["y"] - 7) < 1e-9
    assert all(v[1] <= 2 * k[1] for k, v in got.items())
    assert mix.mix(frame([])).count() == 0
    assert mix.mix(frame([(1, None, None)])).collect()[0].taken == 0


def test_mix_comes_near_targets_and_reruns_agree(spark, frame, prose):
    rows = [(i, prose(i, 5 + i % 60), f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    a, b = (mix.mix(frame(rows).repartition(n), shard_words=300, blocks=1 << 12).collect() for n in (1, 5))
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    by = {}
    for r in a:
        k = by.setdefault((r.source_size, r.target), [0])
        k[0] += r.taken
    assert all(abs(v[0] - t) <= max(10, 0.01 * t) for (_, t), v in by.items())
    reps = Counter(r.doc_id for r in mix.repeated(frame(rows)).collect())
    assert max(reps.values()) <= 2 and mix.repeated(frame(rows)).columns == frame(rows).columns


def test_sainte_lague_by_brute_force(spark):
    votes = [53.0, 24.0, 23.0, 0.0, 7.5, 7.5]
    for seats in (0, 1, 5, 17, 100):
        df = spark.createDataFrame([(1, i, v, seats) for i, v in enumerate(votes)], "g int, p int, v double, n bigint")
        got = {r.p: r.quota for r in mix.sainte_lague(df, ["g"], "p", "v", "n").collect()}
        want = [0] * len(votes)
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(len(votes))] == want


def test_packing_of_odd_rows(spark, frame, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    odd = [*odd, (9, "a<|endoftext|>b  <|endoftext|> \n<|endoftext|>", "a"), (10, "<|endoftext|>", "a"), (11, "無空白の文章" * 300, "a")]
    rows = packing.pack(frame(odd), 128).collect()
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, x, _ in odd]
    whole = Counter()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole[r.ids] += 1
        assert len(r.ids) == 4 * r.length <= 512
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 128
    want = Counter()
    for x in ids:
        n = len(x) // 4
        cut = [0, *range(n % 128 or 128, n + 1, 128)]
        for a, b in zip(cut, cut[1:]):
            want[x[4 * a : 4 * b]] += 1
    assert whole == want and len(by) == -(-sum(len(x) // 4 for x in ids) // 128)
    assert packing.pack(frame([]), 128).count() == 0


def test_fullest_is_the_best_there_is():
    import itertools
    import random

    r = random.Random(5)
    for _ in range(60):
        items = [r.randrange(1, 30) for _ in range(8)]
        use = packing.fullest(dict(Counter(items)), 40)
        top = max(items)
        rest = sorted(items)
        rest.remove(top)
        best = max(sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) <= 40 - top) + top
        assert sum(n * k for n, k in use.items()) == best and all(Counter(items)[n] >= k for n, k in use.items())


def test_units_encode_as_the_tokenizer_does():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["", "  a  b\n\n c\t\td ", "<|endoftext|> hi", "a<|endoftext|>b", "x  <|endoftext|>  y\n\n<|endoftext|><|endoftext|>", "<|endof", "long" * 500 + " z", "\x1c\x1d a\x85b　 c", "it's  don't\r\n x\xa0 \xa0y", "é 😀😀  ​ x"]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(path("byte_bpe_50k.json")).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute_katz(docs, held, order=3):
    """Scores by the definition, and a function that gives p(word | context)."""
    toks = {d: (t or "").encode().lower().split() + [None] for d, t in docs}
    counts, after = [Counter() for _ in range(order + 1)], {}
    for d, w in toks.items():
        if not held(d):
            for n in range(1, order + 1):
                s = [0] * (n - 1) + w
                counts[n].update(tuple(s[i : i + n]) for i in range(len(w)))
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            after.setdefault(g[:-1], []).append((g[-1], c))
    u = counts[1]
    n_, v = sum(u.values()), len(u)
    d_ = {n: katz.discounts(np.array([sum(x == r for x in counts[n].values()) for r in range(1, 7)], float)) for n in range(2, order + 1)}

    def prob(h, w):
        if not h:
            return (u[(w,)] + 0.5) / (n_ + 0.5 * (v + 1))
        if h not in after:
            return prob(h[1:], w)
        d, s = d_[len(h) + 1], sum(c for _, c in after[h])
        left = s - sum(d[min(c, 6)] * c for _, c in after[h])
        if left < 1e-9:
            left, s = left + 1, s + 1
        c = counts[len(h) + 1][(*h, w)]
        return d[min(c, 6)] * c / s if c else left / s / (1 - sum(prob(h[1:], x) for x, _ in after[h])) * prob(h[1:], w)

    for h in list(after)[:20] + list(after)[-20:]:  # each context sums to 1 over the known tokens and one unknown
        assert abs(sum(prob(h, w) for (w,) in u) + prob(h, b"\0unknown") - 1) < 1e-9
    out = {}
    for d, w in toks.items():
        s = [0] * (order - 1) + w
        lp = sum(math.log10(prob(tuple(s[i : i + order - 1]), x)) for i, x in enumerate(w))
        out[d] = (held(d), len(w), sum(u[(x,)] > 0 for x in w), n_, sum(math.log10(prob((), x)) for x in w), lp)
    return out


KATZ_DOCS = lambda prose: [(i, prose(i % 9, 20 + i) if i % 4 else prose(1, 15), "a") for i in range(40)] + [(40, None, None), (41, "", "b"), (42, "A a\nb", "b")]


@pytest.mark.parametrize(("size", "order"), [(40, 3), (2_000_000, 3), (150, 2), (100, 4), (100, 1)])
def test_katz_scores_are_those_of_brute_force(spark, frame, prose, size, order):
    docs = KATZ_DOCS(prose)
    want = brute_katz([(d, t) for d, t, _ in docs], lambda d: zlib.crc32(str(d).encode()) % 5 == 1, order)
    rows = katz.score_documents(frame(docs).repartition(3), katz.held_out(), size, order, part_tokens=size // 4).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and np.allclose(tuple(r)[5:], want[r.doc_id][4:], rtol=1e-9)


def test_katz_tables_score_other_texts(spark, frame, prose, tmp_path):
    docs = KATZ_DOCS(prose)
    seen, new = docs[:25], [(d, t, s) for d, t, s in docs[20:]]
    at = f"{tmp_path}/model"
    katz.score_documents(frame(seen).repartition(2), F.lit(False), 60, save=at, part_tokens=25).count()
    want = brute_katz([(d, t) for d, t, _ in seen] + [(1000 + d, t) for d, t, _ in new], lambda d: d >= 1000)
    rows = katz.score_with(frame(new), at, 90).collect()
    assert len(rows) == len(new)
    for r in rows:
        assert tuple(r)[1:5] == want[1000 + r.doc_id][:4] and np.allclose(tuple(r)[5:], want[1000 + r.doc_id][4:], rtol=1e-9)


def test_katz_of_odd_rows(spark, frame, odd):
    rows = katz.score_documents(frame(odd), katz.held_out()).collect()
    assert len(rows) == len(odd) and all(math.isfinite(r.score) for r in rows)
    assert katz.score_documents(frame([]), katz.held_out()).count() == 0
    assert {r.train_tokens for r in katz.score_documents(frame(odd), F.lit(True)).collect()} == {0}


@pytest.fixture(scope="module")
def marked(spark, frame, prose):
    """Documents of which every third is junk (symbols, repeats) and every fifth has a slur, with labels."""
    rows, labels = [], []
    for i in range(600):
        t = prose(i, 40 + i % 50) + "."
        if i % 3 == 0:
            t = " ".join(w + "***" for w in t.split()) if i % 2 else "\n".join([t] * 4)
        if i % 5 == 0:
            w = t.split(" ")
            w.insert(7, "Slur1," if i % 2 else "slur2!")
            t = " ".join(w)
        rows.append((i, t, "a"))
        labels.append((i, int(i % 3 != 0), int(i % 5 == 0)))
    labels += [(None, 1, 0), (5, None, None), (999_999, 1, 1)]
    return frame(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(spark, marked, frame, odd):
    docs, labels = marked
    got = [(r.doc_id, r.score) for r in quality.score_quality(docs, labels, quality.held_out()).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) > 100 and np.mean([(s >= 0.7) == (d % 3 != 0) for d, s in got]) > 0.97 and all(0 <= s <= 1 for _, s in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and np.mean([r.doc_id % 3 != 0 for r in kept.collect()]) > 0.97
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(frame(odd), none, quality.held_out()).collect()} == {0.5}
    assert quality.score_quality(frame([]), labels, quality.held_out()).count() == 0
    assert quality.score_quality(frame(odd).union(docs), labels, quality.held_out()).count() == len(odd) + 600
    assert quality.keep_good(frame(odd), none).count() == len(odd)


def test_labels_of_held_out_rows_are_never_used(spark, marked):
    docs, labels = marked
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = lambda fn, h: {tuple(r) for r in fn(docs, labels, h).collect()} == {tuple(r) for r in fn(docs, flipped, h).collect()}
    assert same(quality.score_quality, quality.held_out()) and same(toxicity.score_toxicity, toxicity.held_out())


def test_isotonic_rises_and_pools():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(y) >= 0).all() and x.tolist() == [0, 1, 2, 3] and y[1] == y[2]


def test_toxicity_on_held_out_rows(spark, marked, frame, odd):
    docs, labels = marked
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, labels, toxicity.held_out()).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) > 80 and np.mean([(s >= 0.5) == (d % 5 == 0) for d, s in got]) > 0.97
    assert {r.score for r in toxicity.score_toxicity(frame(odd), labels.limit(0), toxicity.held_out()).collect()} == {0.0}
    assert toxicity.score_toxicity(frame([]), labels, toxicity.held_out()).count() == 0
    assert toxicity.score_toxicity(frame(odd).union(docs), labels, toxicity.held_out()).count() == len(odd) + 600


def test_rules_are_learnt_and_emitted(spark, marked, frame, odd):
    docs, labels = marked
    out, learnt = rules.quality_rules(docs, labels)
    rows = out.collect()
    assert 1 <= len(learnt) <= 16 and np.mean([r.kept == (r.doc_id % 3 != 0) for r in rows]) > 0.97
    assert all(not r.kept for r in rows if r.base_failed)
    plain, none = rules.quality_rules(frame(odd), labels.limit(0))
    assert none == [] and all(r.kept != r.base_failed for r in plain.collect()) and plain.count() == len(odd)
    assert rules.quality_rules(frame([]), labels)[0].count() == 0
    assert "case when" in str(rules.verdict(learnt)._jc.toString()).lower()
