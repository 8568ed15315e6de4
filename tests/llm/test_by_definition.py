"""Learnt operators against their definitions, written out plainly."""

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import packing, quality, rules, toxicity
from sluice.llm.stats import FEATURES, ratios


def test_fourier_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 5))
    z = quality.Fourier.draw(np.zeros(5), np.ones(5), 20_000, 3.0, 2)(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 9))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_normal_equations_and_ridge_are_direct_ones(spark):
    r = np.random.default_rng(2)
    x, y, f = r.normal(size=(300, len(FEATURES))), r.integers(0, 2, 300).astype(float), r.integers(0, quality.FOLDS, 300)
    rows = spark.createDataFrame([(float(a), int(k), *map(float, v)) for a, k, v in zip(y, f, x)], f"y double, f int, {', '.join(c + ' double' for c in FEATURES)}").repartition(5)
    phi = quality.Fourier.draw(x.mean(0), x.std(0), 32, 3.0, 7)
    parts = quality.normal_equations(rows, phi)
    z = phi(x)
    for k, (a, b) in parts.items():
        assert np.allclose(a, z[f == k].T @ z[f == k]) and np.allclose(b, z[f == k].T @ y[f == k])
    # ridge as least squares with sqrt(lambda) rows below
    lam = 0.3
    direct = np.linalg.lstsq(np.vstack([z, np.sqrt(lam) * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(quality.ridge(list(parts.values()), lam), direct, atol=1e-8)


def test_ftrl_is_that_of_a_plain_loop():
    r = np.random.default_rng(3)
    bits, alpha, beta, l1, l2 = 6, 0.5, 1.0, 0.4, 0.02
    docs = [np.unique(r.integers(0, 64, 8)).astype(np.int32) for _ in range(120)]
    y = r.integers(0, 2, 120).astype(float)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        lam = 0.0 if i == 64 else l1
        if abs(z[i]) <= lam:
            return 0.0
        return -(z[i] - np.sign(z[i]) * lam) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for d, t in zip(docs, y):
            ids = [*d.tolist(), 64]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + np.exp(-sum(w.values()))) - t
            for i in ids:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.ftrl(docs, y, 2, bits, alpha, beta, l1, l2)
    assert np.allclose(got, [weight(i) for i in range(65)])


def test_a_rule_grows_by_the_best_condition_there_is():
    """The first condition of a rule has the greatest FOIL gain over all features, sides and thresholds between quantiles."""
    r = np.random.default_rng(4)
    x = {"a": r.normal(size=400), "b": r.integers(0, 9, 400).astype(float), "c": r.normal(size=400)}
    bad = (x["a"] > 0.8) | (r.random(400) < 0.1)
    best = -1.0
    for v in x.values():
        q = np.unique(np.quantile(v, np.linspace(0, 1, 41)))
        for t in (q[1:] + q[:-1]) / 2:
            for on in (v > t, v <= t):
                p, n = bad[on].sum(), (~bad[on]).sum()
                if p:
                    best = max(best, p * (np.log2(p / (p + n)) - np.log2(bad.mean())))
    c = rules._grow(x, bad, 1)[0]
    on = x[c.feature] > c.bound if c.above else x[c.feature] <= c.bound
    p, n = bad[on].sum(), (~bad[on]).sum()
    assert np.isclose(p * (np.log2(p / (p + n)) - np.log2(bad.mean())), best)


def test_a_decision_list_is_its_rules_in_order(spark):
    """Covering on labelled rows, and the expression that is emitted, against the rules walked one by one."""
    r = np.random.default_rng(5)
    x = {f: r.random(500) for f in ratios()}
    bad = (x["symbols"] > 0.7) & (x["distinct"] <= 0.6) | (x["upper"] > 0.85)
    learnt = rules.learn(x, bad)
    hold = lambda rule, i: all((x[c.feature][i] > c.bound) == c.above for c in rule)
    want = [not any(hold(rule, i) for rule in learnt) for i in range(500)]
    assert learnt and np.mean(np.array(want) != bad) > 0.9
    rows = spark.createDataFrame([(i, *(float(x[f][i]) for f in x)) for i in range(500)], "i int, " + ", ".join(f"{f} double" for f in x))
    got = {q.i: q.kept for q in rows.select("i", rules.verdict(learnt, {f: F.col(f) for f in x}).alias("kept")).collect()}
    assert [got[i] for i in range(500)] == want


def test_the_cache_of_units_is_bounded(monkeypatch):
    import random

    monkeypatch.setattr(packing, "CACHE", 1 << 16)
    e, r = packing.Encoder(packing.vocabulary()), random.Random(6)
    whole = packing.Encoder(packing.vocabulary())
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(300)) + "x" * 500]
        assert list(e.encode(texts, 1000)) == list(whole.encode(texts))
        assert e.held < 1 << 18 and all(len(u) <= packing.LONGEST for u in e.seen)


def test_short_texts_are_read_whole_and_long_ones_by_units():
    """The same ids either way; only texts that are too long for one pass fill the cache."""
    from sluice.llm import packing

    e = packing.Encoder(packing.vocabulary())
    short = ["", " ", "it's  a\n\n b　c\xa0", "\U0001f600 \x85x", "<|endoftext|> a<|endoftext|>", " " * 65000 + "x", "ab" * 30000]
    long = [" " * (1 << 18) + "x", "some words " * 7000]
    got = list(e.encode(short))
    assert not e.seen and got == list(packing.Encoder(packing.vocabulary()).by_units(short))
    assert list(e.encode(long)) == list(packing.Encoder(packing.vocabulary()).by_units(long)) and e.seen
