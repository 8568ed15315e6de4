import re

import numpy as np
import pyarrow as pa
import xxhash

from sluice.llm import common, simhash, stats
from sluice.llm.stats import COUNTS, FEATURES, ratio_matrix, ratios


def test_words_and_hashes_follow_the_texts():
    texts = ["a b", None, "", " x\n", "bAb\x0bC a", "é 　 ü", "a"]
    for arr in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        w = common.words(arr, lower=True)
        got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
        h = w.hashes()
        flat = sum(got, [])
        assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_span_hashes_by_definition():
    """The same in any place, over blocks too, and as the polynomial says."""
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 300_000).astype(np.uint8)
    data[200_000:200_100] = data[5:105]
    start = np.array([0, 5, 65_500, 65_536, 131_072, 200_000, 299_990])
    end = np.array([1, 105, 65_600, 65_540, 131_073, 200_100, 300_000])
    got = common.span_hashes(data, start, np.sort(end)) if (np.sort(end) == end).all() else [common.span_hashes(data, start[i : i + 1], end[i : i + 1])[0] for i in range(7)]
    for g, a, z in zip(got, start.tolist(), end.tolist()):
        h = sum((int(data[i]) + 1) * pow(common._P, i - a, 1 << 64) for i in range(a, z)) % (1 << 64)
        want = common.mix(np.array([(h + (z - a) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0]
        assert g == want
    assert got[1] == got[5] and len(common.span_hashes(data, start[:0], end[:0])) == 0


def test_grams_stay_in_documents():
    w = common.words(pa.array(["a b c", "d", "", "a b c d"]))
    assert common.gram_starts(w.first, 3).tolist() == [0, 4, 5]
    g = common.grams(w.hashes(), 3)
    assert g[0] == g[4] != g[5]


def test_pieces_cover_all_rows():
    b = pa.record_batch({"text": ["x" * n for n in (5, 0, 100, 3, 3)]})
    assert [p.num_rows for p in common.pieces(b, "text", 10)] == [2, 1, 2]


def test_fingerprints_by_definition(prose):
    texts = ["", None, "One two", "a b c d", prose(5, 200), prose(6, 70_000)[:300_000]]
    got = simhash.fingerprints(pa.array(texts), 4, 42)
    for t, f in zip(texts, got):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in sh], np.uint64)
        want = sum(1 << j for j in range(64) if 2 * int(((h >> np.uint64(j)) & np.uint64(1)).sum()) > len(h))
        assert int(f) % (1 << 64) == want


def test_ratios_are_the_same_in_both_forms(spark, frame, odd):
    rows = stats.document_stats(frame(odd)).collect()
    m = ratio_matrix([np.array([r[c] for r in rows]) for c in COUNTS])
    cols = spark.createDataFrame(rows).select(*[c.alias(f) for f, c in ratios().items()]).collect()
    assert tuple(ratios()) == FEATURES and np.allclose(m, np.array([list(r) for r in cols], float))


def test_counts_by_definition(odd, prose):
    texts = [t for _, t, _ in odd if t is None or len(t) < 5000] + ["a\na\n\nb\na ", "x y z v w x y z v w", "#*$%&|<> 1!", "\n\n", prose(9, 12) + "\n" + prose(9, 12)]
    got = dict(zip(COUNTS, stats.measure(pa.array(texts))))
    for i, t in enumerate(t or "" for t in texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) - (len(w) - len(set(w))))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want


def test_tables_of_half_a_million_keys_stay_off_the_driver(spark):
    from sluice.llm import passages, simhash

    for limit in (simhash.BROADCAST_KEYS, passages.BROADCAST_COPIES):
        hinted = lambda n: "broadcast" in common.maybe_broadcast(spark.range(1), n, limit)._jdf.queryExecution().logical().toString().lower()  # noqa: B023, E731
        assert hinted(1000) and not hinted(500_000)
