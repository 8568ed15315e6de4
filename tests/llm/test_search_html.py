import numpy as np
from pyspark.sql import functions as F

from sluice.llm import ann, html


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(1500, 16)), r.normal(size=(10, 1, 16)).repeat(40, 1).reshape(-1, 16) + r.normal(scale=0.05, size=(400, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for row in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    hit = 0
    for q in range(0, 1900, 50):
        want = brute(np.arange(1900), x.astype(float), q, 10)
        hit += sum(s <= want[-1][1] + 1e-12 for _, s in got[q])
        assert all(abs(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum()) - s) < 1e-12 for v, s in got[q]) and len(got[q]) == 10
    assert hit / 380 >= 0.9


def test_lists_read_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)  # 1,000 lists
    r = np.random.default_rng(3)
    x = r.normal(size=(8000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    hit, cut_off = 0, {q: brute(np.arange(8000), x.astype(float), q, 10)[-1][1] for q in range(0, 8000, 100)}
    for row in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        hit += row.score <= cut_off[row.query_id] + 1e-12
    assert hit / 800 >= 0.9, hit / 800


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (100, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [nan, 1.0], "a"), (6, [inf, 1.0], "a"), (7, [None, 1.0], "a"),
            (None, [1.0, 1.0], "a"), (8, [1.0], "a"), (9, [], "a"), (200, [0.0, 1.0], "a"), (200, [5.0, 5.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, h string")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    s2 = round(2**0.5, 6)
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, s2), (0, 4, 200, s2), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, s2), (100, 4, 200, s2),
                   (200, 1, 2, 0.0), (200, 2, 0, s2), (200, 3, 1, s2), (200, 4, 100, s2)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """128 unit vectors along axes: all others are equally far from a query."""
    ids = np.random.default_rng(4).permutation(128)
    df = spark.createDataFrame([(int(i), [float(j == k) for j in range(128)]) for k, i in enumerate(ids)], "vec_id bigint, embedding array<float>")
    got = [r.vec_id for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 11))


def test_a_hot_vector_is_one_entry_and_exact(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id").cast("double"), F.lit(1.0))).cast("array<float>").alias("embedding"))
    rows = ann.nearest(df, F.col("vec_id") % 500 == 0).collect()
    for q in range(0, 3000, 500):
        mine = sorted((r.rank, r.vec_id) for r in rows if r.query_id == q)
        assert [v for _, v in mine] == [v for v in range(0, 24, 2) if v != q][:10]


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_blocks():
    got = html.blocks(page('<nav><a href="x>y">Home</a></nav><p>One &amp; <b>two<br>three<p>Four<ul><li>a<li>b</ul><script>var x="</p>";</script><!-- <p>no --><div>five'))
    assert [b[1] for b in got] == ["Home", "One & two three", "Four", "a", "b", "five"]
    assert got[0][0][-1] == "nav" and got[0][2] == 4 and html.blocks("") == [] and html.blocks("a < b") == [((), "a < b", 0)]


def test_malformed_markup_takes_linear_time():
    import time

    n = 300_000
    for bad in ("<a ", "<a \"> \" ", "<a '", "</a ", "<a<", "<!-", "<title>", "<b></i>", "<div>", "<!--", "<a x=\"'>", "<i><p>", "</p>", "&#"):
        at = time.perf_counter()
        html.blocks("<p>first</p>" + bad * (n // len(bad)) + "<p>last words")
        assert time.perf_counter() - at < 10, bad
    assert [b[1] for b in html.blocks("<p>one<p title='x>two</p><p>three")] == ["one", "two", "three"]
    assert [b[1] for b in html.blocks("a <b c")] == ["a <b c"] and [b[1] for b in html.blocks("x <!-- y")] == ["x"]


def test_lstm_gradients_are_numeric_ones():
    r = np.random.default_rng(6)
    steps, m, wide, hid = 5, 3, 4, 3
    x, on = r.normal(size=(steps, m, wide)), (r.random((steps, m)) < 0.7).astype(float)
    p = {"w": r.normal(size=(wide, 4 * hid)), "u": r.normal(size=(hid, 4 * hid)), "b": r.normal(size=4 * hid)}
    to = r.normal(size=(steps, m, hid))
    loss = lambda: float((html._lstm(x, on, p["w"], p["u"], p["b"])[0] * to).sum())
    _, saved = html._lstm(x, on, p["w"], p["u"], p["b"], True)
    for k, got in zip("wub", html._lstm_back(x, to, p["u"], saved)):
        for i in np.ndindex(p[k].shape):
            was, e = p[k][i], 1e-6
            p[k][i] = was + e
            up = loss()
            p[k][i] = was - e
            down = loss()
            p[k][i] = was
            assert abs((up - down) / (2 * e) - got[i]) < 1e-5 * max(1, abs(got[i]))


def test_lstm_states_are_those_of_a_plain_loop():
    r = np.random.default_rng(7)
    x, w, u, b = r.normal(size=(6, 1, 4)), r.normal(size=(4, 12)), r.normal(size=(3, 12)), r.normal(size=12)
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, c = np.zeros(3), np.zeros(3)
    for t, got in enumerate(html._lstm(x, np.ones((6, 1)), w, u, b)[0][:, 0]):
        z = x[t, 0] @ w + h @ u + b
        c = sig(z[3:6] + 1) * c + sig(z[:3]) * np.tanh(z[9:])
        h = sig(z[6:9]) * np.tanh(c)
        assert np.allclose(got, h)


def test_extraction(spark, prose):
    para = [prose(i, 30).capitalize() + "." for i in range(4)]
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(5)) + "</ul></nav>"
    rows = [
        (1, "u", page(menu + f"<div class='ad'>Buy now</div><article><h1>A title here</h1><p>{para[0]}</p><p><b>{para[1]}<br><p>{para[2]}</p></article><footer>&copy; us</footer>")),
        (2, "u", page(f"<header class='masthead'><p>Site name</p></header>{menu}<main><h1>Other title</h1><p>{para[3]}</p><p>{para[0]}</p></main><section id='comments'><div class='comment'><p>{para[1]}</p></div></section>"
                      f"<aside class='sidebar'><p>{para[2]}</p></aside><form><label>Mail</label><button>Go</button></form>")),
        (3, None, None), (4, "u", ""), (4, "u", page("")), (None, "u", page(f"<article><p>{para[0]}</p></article>")),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = html.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert by[1] == "\n".join(["A title here", para[0], para[1], para[2]])
    assert by[2] == "\n".join(["Other title", para[3], para[0]])
    assert by[3] == "" and by[4] == "" and by[None] == para[0] and len(got) == len(rows)
    assert html.extract(df.limit(0)).count() == 0


def test_labeller_on_pages_of_its_own_kind():
    pages = html.training_pages(80, seed=77)
    got = html.label(html.weights(), [b for b, _ in pages])
    assert np.mean(np.concatenate(got) == np.concatenate([np.array(y) for _, y in pages])) > 0.97
