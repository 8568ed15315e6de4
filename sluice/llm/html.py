"""Main-text extraction from raw HTML: a recurrent labeller of leaf blocks.

A page becomes the sequence of its leaf blocks. Each block has a vector: its tag path (names, classes and ids
of its ancestors) and its words, hashed, and a few measures of its text. A bidirectional LSTM reads the whole
sequence both ways and labels every block as article or not. Weights are trained here, in numpy, on pages
that are written for it from layouts with known labels; no page of the input is learnt from.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import U64, mapped, pieces, words

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown as text.
RAW = frozenset("script style noscript template title textarea iframe svg math object audio video canvas head".split())
#: An open one of the values ends where the key begins, unless a container of the second set lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_NAME_AT = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_EVENT = re.compile(r"""[>"']""")
#: Open elements at most, as in browsers: one that would lie deeper is not nested in its predecessors.
DEPTH = 512
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")

PATH, WORD, PLAIN_F = 128, 32, 8
WIDE = PATH + WORD + PLAIN_F
HIDDEN = 24


class Markup:
    """Tags, comments and declarations of a page, in time linear in its length whatever is left open."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.failed: set[int] = set()  # closing quotes from which no tag ends

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin here ends, quoted values skipped; -1 if it doesn't."""
        seen = []
        while m := _EVENT.search(self.html, at):
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0], m.end())
            if close < 0 or close in self.failed:
                break
            seen.append(close)
            at = close + 1
        self.failed.update(seen)
        return -1

    def next(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, name, closing, attributes) of the next piece of markup; no name for a comment or declaration."""
        html = self.html
        while (i := html.find("<", pos)) >= 0:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, len(html) if end < 0 else end + 3, "", "", ""
            if i > self.last:  # no tag ends any more; a comment may begin
                i = html.find("<!--", i)
                if i < 0:
                    return None
                pos = i
                continue
            if m := _NAME_AT.match(html, i + 1):
                end = self._end(m.end())
                if end < 0 and m[1]:
                    return i, html.index(">", i) + 1, "", "", ""
                if end < 0:  # a quote is left open: the tag ends where it can
                    end = html.index(">", m.end())
                return i, end + 1, m[2], m[1], html[m.end() : end]
            if html[i + 1 : i + 2] in ("!", "?", "/"):
                return i, html.index(">", i) + 1, "", "", ""
            pos = i + 1
        return None


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters in links) of each leaf block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, at, path = 0, 0, ()

    def flush():
        nonlocal linked, text
        if text:
            t = "".join(text)
            t = " ".join((unescape(t) if "&" in t else t).split())
            if t:
                out.append((path, t, linked))
            text = []
        linked = 0

    def shut(k: int) -> None:
        """Ends open elements from the k-th on."""
        nonlocal path
        if any(n in BLOCK for n, _ in stack[k:]):
            flush()
        del stack[k:]
        path = sum((p for n, p in stack if n in BLOCK), ())

    pos, n, links = 0, len(html), 0
    markup, missing = Markup(html), set()
    while pos < n:
        m = markup.next(pos)
        end = m[0] if m else n
        if end > pos:
            s = html[pos:end]
            text.append(s)
            if links:
                linked += len(s)
        if not m:
            break
        _, pos, name, closing, attrs = m
        if not name:
            continue
        name, single = name.lower(), html[pos - 2] == "/"
        if closing:
            if name == "p" and not any(t == "p" for t, _ in stack):
                flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    shut(k)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            links = sum(t == "a" for t, _ in stack)
            continue
        if name in RAW:
            if name == "head" or not single:
                stop = None if name in missing else re.compile(r"</head\s*>|<body\b" if name == "head" else rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                if stop:
                    pos = stop.start() if stop[0][1] != "/" else stop.end()
                else:
                    missing.add(name)  # nor is there one further on
                    pos = n if name in ("script", "style") else pos
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    shut(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            if name in ENDS:
                ends, between = ENDS[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        shut(k)
                        break
                    if stack[k][0] in between:
                        break
            flush()
        if name in VOID or single or len(stack) >= DEPTH:
            continue
        marks: tuple[str, ...] = (name,)
        if "=" in attrs and name in BLOCK:
            marks += tuple("." + w for a in _ATTR.finditer(attrs) for w in _NAME.findall((a[1] or a[2] or a[3] or "").lower()))
        stack.append((name, marks))
        if name in BLOCK:
            path = path + marks
        links += name == "a"
    flush()
    return out


@functools.lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    marks = [p for p in path if p not in ("html", "body")]
    for k, p in enumerate([*marks, *(f"last:{m}" for m in marks[-1:])]):
        h = zlib.crc32(p.encode())
        v[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
        h = zlib.crc32(b"+" + p.encode())
        v[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
    return np.clip(v, -2, 2)


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> np.ndarray:
    """The vectors of all blocks of the pages, in order."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), WIDE), np.float32)
    if not flat:
        return out
    out[:, :PATH] = np.stack([_path_vector(b[0]) for b in flat])
    w = words(pa.array([b[1] for b in flat]), lower=True)
    n = np.maximum(w.counts, 1)
    bag = np.bincount(w.doc() * WORD + (w.hashes() % U64(WORD)).astype(np.int64), minlength=len(flat) * WORD).reshape(-1, WORD)
    out[:, PATH : PATH + WORD] = bag / n[:, None]
    size = np.diff(w.off)
    count = lambda chars: np.bincount(np.searchsorted(w.off, np.flatnonzero(np.isin(w.data, np.frombuffer(chars, np.uint8))), side="right") - 1, minlength=len(flat))
    out[:, -8] = np.log1p(w.counts) / 4
    out[:, -7] = np.minimum(1, [b[2] / len(b[1]) for b in flat])
    out[:, -6] = np.minimum(1, count(b".,;:?!") / n)
    out[:, -5] = count(b"0123456789") / np.maximum(size, 1)
    out[:, -4] = [len(b[0]) / 10 for b in flat]
    lens = np.array([len(p) for p in pages])
    first = np.repeat(np.cumsum(lens) - lens, lens)
    out[:, -3] = (np.arange(len(flat)) - first) / np.maximum(np.repeat(lens, lens), 1)
    out[:, -2] = [b[1][-1] in ".?!" for b in flat]
    out[:, -1] = n == 1
    return out


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, on: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of an LSTM over x (steps, pages, wide); where ``on`` is 0 a state stays."""
    steps, m, _ = x.shape
    hid = u.shape[0]
    h, c = np.zeros((m, hid), x.dtype), np.zeros((m, hid), x.dtype)
    hs, saved = np.empty((steps, m, hid), x.dtype), []
    xw = x @ w + b
    for t in range(steps):
        z = xw[t] + h @ u
        i, f, o = _sigmoid(z[:, :hid]), _sigmoid(z[:, hid : 2 * hid] + 1), _sigmoid(z[:, 2 * hid : 3 * hid])
        g = np.tanh(z[:, 3 * hid :])
        k = on[t][:, None]
        nc = f * c + i * g
        tc = np.tanh(nc)
        if keep:
            saved.append((i, f, o, g, c, tc, h, k))
        c = k * nc + (1 - k) * c
        h = k * (o * tc) + (1 - k) * h
        hs[t] = h
    return hs, saved


def _lstm_back(x: np.ndarray, dhs: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    du = np.zeros_like(u)
    dz = np.empty((*dhs.shape[:2], u.shape[1]), x.dtype)
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, g, c, tc, h, k = saved[t]
        dh = dh + dhs[t]
        do_ = dh * k * tc
        dnc = dc * k + dh * k * o * (1 - tc * tc)
        z = np.hstack([dnc * g * i * (1 - i), dnc * c * f * (1 - f), do_ * o * (1 - o), dnc * i * (1 - g * g)])
        dz[t] = z
        du += h.T @ z
        dh = dh * (1 - k) + z @ u.T
        dc = dc * (1 - k) + dnc * f
    flat = dz.reshape(-1, dz.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _padded(vecs: np.ndarray, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(lens)
    x, on = np.zeros((steps, len(lens), WIDE), np.float32), np.zeros((steps, len(lens)), np.float32)
    at = 0
    for j, n in enumerate(lens):
        x[:n, j], on[:n, j] = vecs[at : at + n], 1
        at += n
    return x, on


def _logits(p: dict[str, np.ndarray], x: np.ndarray, on: np.ndarray, keep: bool = False):
    hf, sf = _lstm(x, on, p["wf"], p["uf"], p["bf"], keep)
    hb, sb = _lstm(x[::-1], on[::-1], p["wb"], p["ub"], p["bb"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ p["v"] + p["c"], h, sf, sb


def train(pages: list[tuple[list, list[int]]], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights from pages of blocks and their labels (1: article), by Adam on the log loss of every block."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
    p = {k: init(*s) for k, s in {"wf": (WIDE, 4 * HIDDEN), "uf": (HIDDEN, 4 * HIDDEN), "wb": (WIDE, 4 * HIDDEN), "ub": (HIDDEN, 4 * HIDDEN), "v": (2 * HIDDEN,)}.items()}
    p |= {"bf": np.zeros(4 * HIDDEN, np.float32), "bb": np.zeros(4 * HIDDEN, np.float32), "c": np.zeros(1, np.float32)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    vecs = [vectors([b]) for b, _ in pages]
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for e in range(epochs):
        for gi in rng.permutation(len(groups)):
            g = groups[gi]
            x, on = _padded(np.concatenate([vecs[i] for i in g]), [len(vecs[i]) for i in g])
            x[:, rng.random(len(g)) < 0.4, PATH:] = 0  # words may mislead: paths must do without them
            y = np.zeros_like(on)
            for j, i in enumerate(g):
                y[: len(vecs[i]), j] = pages[i][1]
            z, h, sf, sb = _logits(p, x, on, True)
            dz = (_sigmoid(z) - y) * on / on.sum()
            dh = dz[:, :, None] * p["v"]
            grad = {"v": np.einsum("tm,tmh->h", dz, h), "c": np.array([dz.sum()], np.float32)}
            grad["wf"], grad["uf"], grad["bf"] = _lstm_back(x, dh[:, :, :HIDDEN], p["uf"], sf)
            grad["wb"], grad["ub"], grad["bb"] = _lstm_back(x[::-1], dh[::-1, :, HIDDEN:], p["ub"], sb)
            step += 1
            for k in p:
                d = np.clip(grad[k], -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (0.5 ** (e / 3)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def label(p: dict[str, np.ndarray], pages: list[list], cells: int = 16_384) -> list[np.ndarray]:
    """For each page, which of its blocks are article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= cells:
            hi += 1
        group = order[lo:hi]
        x, on = _padded(vectors([pages[i] for i in group]), [len(pages[i]) for i in group])
        z = _logits(p, x, on)[0]
        for j, i in enumerate(group):
            out[i] = z[: len(pages[i]), j] > 0
        lo = hi
    return out


# ---- pages to learn from

_SYL = "ba be bi co cu da de di en er fa fo ga ge ha hi in ja ke la le li ma me mi na ne no on or pa pe qui ra re ri sa se si so ta te ti to un ur va ve vo za zu é ü ß ñ ación ment keit tion".split()
_ROLES = {
    "nav": "nav menu navigation navbar topnav breadcrumb breadcrumbs toc tabs links skip pagination pager".split(),
    "header": "header masthead banner topbar branding site head logo".split(),
    "footer": "footer foot bottom copyright colophon legal credits".split(),
    "side": "sidebar side aside widget related recommended popular trending more rail tags categories".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor adbox teaser dfp promotion".split(),
    "notice": "notice cookie cookies consent alert popup modal overlay gdpr newsletter subscribe signup message warning toast banner".split(),
    "form": "form search login contact signup poll survey".split(),
    "comment": "comments comment replies reply discussion respond disqus commentlist reviews thread user".split(),
    "share": "share social sharing follow buttons tools actions".split(),
    "main": "content article post entry story body text main page detail".split(),
}


def training_pages(n: int = 640, seed: int = 20) -> list[tuple[list, list[int]]]:
    """Pages of random layouts and words with their labels, as blocks; article words are marked while a page is written."""
    rng, style = random.Random(seed), 0
    pick = rng.choice
    chance = lambda p: rng.random() < p

    def word():
        return "".join(pick(_SYL) for _ in range(rng.randrange(1, 5)))

    def sentence(lo=3, hi=18):
        ws = [word() for _ in range(rng.randrange(lo, hi))]
        if style == 1:
            ws = [w + pick(["***", "$$$", "&amp;&amp;&amp;", "###", "%%%"]) for w in ws]
        elif style == 2:
            ws = [w.upper() + "!!" for w in ws]
        elif style == 3:
            ws = [x for w in ws for x in (w, "|")]
        return " ".join(ws).capitalize() + pick([".", ".", ".", "?", "!", ""])

    def prose():
        return " ".join(sentence() for _ in range(rng.randrange(1, 6)))

    def link(t):
        return f'<a href="/{word()}">{t}</a>'

    def attr(role):
        names = pick(_ROLES[role])
        if chance(0.4):
            names += pick(["-", " ", "_"]) + pick([*_ROLES[role], word(), "box", "wrapper", "inner", "list", "item", "container"])
        return f' {pick(["class", "class", "id"])}="{names}"'

    def box(role, tag, inner):
        named = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(role)
        if named and chance(0.55):
            return f"<{named}{attr(role) if chance(0.4) else ''}>{inner}</{named}>"
        return f"<{tag}{attr(role)}>{inner}</{tag}>"

    def items(k, linked=True):
        return "<ul>" + "".join(f"<li>{link(' '.join(word() for _ in range(rng.randrange(1, 5)))) if linked else sentence(1, 8)}</li>" for _ in range(k)) + "</ul>"

    def boiler(role):
        tag = pick(["div", "div", "section"])
        if role == "nav":
            return box(role, tag, items(rng.randrange(2, 9)) if chance(0.8) else " ".join(link(word()) for _ in range(5)))
        if role == "header":
            return box(role, tag, (f"<h1>{sentence(1, 4)}</h1>" if chance(0.3) else "") + (f"<p>{sentence(2, 8)}</p>" if chance(0.6) else link(word())))
        if role == "footer":
            return box(role, tag, pick([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p>&copy; {word()}</p><p>{sentence()}</p>", f"<p>{prose()}</p>" + items(4)]))
        if role == "side":
            return box(role, tag, f"<h{pick('234')}>{sentence(1, 4)}</h3>" + pick([items(rng.randrange(2, 7)), f"<p>{prose()}</p>", items(3, False)]))
        if role == "ad":
            return box(role, tag, pick([sentence(), f"<p>{prose()}</p>", link(sentence()), f"<span>{sentence()}</span>"]))
        if role == "notice":
            return box(role, tag, pick([f"<p>{sentence()}</p><button>{word()}</button>", sentence(), prose()]))
        if role == "form":
            return box(role, tag, f"<label>{sentence(1, 4)}</label><input type=text><select><option>{word()}<option>{word()}</select><button>{word()}</button>" + (f"<p>{sentence()}</p>" if chance(0.5) else ""))
        if role == "share":
            return box(role, tag, items(3))
        inner = "".join(pick([f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f"<li><p>{prose()}</p></li>", f"<p>{prose()}</p>"]) for _ in range(rng.randrange(1, 7)))
        return box("comment", tag, (f"<h3>{sentence(1, 3)}</h3>" if chance(0.5) else "") + inner)

    def mark(s):  # a letter that no other word has
        return re.sub(r"(^|>)([^<>]+)", lambda m: m[1] + (m[2] if not m[2].strip() else m[2] + " ☂"), s)

    def article():
        nonlocal style
        style = pick([0, 0, 0, 0, 0, 0, 1, 1, 2, 3])  # noisy pages have articles, too
        out = [f"<h1>{sentence(2, 12)}</h1>"] if chance(0.8) else []
        loose = chance(0.4)
        for _ in range(rng.randrange(20, 60) if chance(0.12) else rng.randrange(1, 14)):
            k = rng.random()
            if k < 0.72:
                t = word() if chance(0.04) else prose()
                if chance(0.2):
                    t += f" {link(word())} {sentence()}"
                out.append(f"<p><b>{t}<br>" if loose and chance(0.3) else f"<p>{t}" + ("</p>" if not loose or chance(0.7) else ""))
            elif k < 0.8:
                out.append(f"<h{pick('23')}>{sentence(1, 6)}</h2>".replace("</h2>", "</h2>"))
            elif k < 0.88:
                out.append(items(rng.randrange(2, 6), False))
            elif k < 0.93:
                out.append(f"<blockquote>{'<p>' if chance(0.5) else ''}{prose()}</blockquote>")
            elif k < 0.96:
                out.append(f"<pre>{prose()}</pre>")
            else:
                out.append(f"<table><tr><td>{sentence(1, 4)}</td><td>{sentence(1, 4)}</td></tr></table>")
        out, style = [mark(s) for s in out], 0
        if chance(0.3):
            out.insert(rng.randrange(len(out) + 1), boiler(pick(["ad", "share", "notice", "side", "form", "nav"])))
        if chance(0.15):
            out.append(boiler("comment"))
        body = "".join(out)
        k = rng.random()
        if k < 0.5:
            body = f"<article>{body}</article>"
        elif k < 0.65:
            body = f"<main>{body}</main>"
        else:
            body = f"<{(t := pick(['div', 'section', 'div']))}{attr('main')}>{body}</{t}>"
        if chance(0.3):
            body = f"<main>{body}</main>" if chance(0.5) else f"<div{attr('main')}>{body}</div>"
        return body

    out = []
    while len(out) < n:
        parts = [boiler(r) for r in ("header", "nav", "ad", "notice", "form") if chance(0.45)]
        rng.shuffle(parts)
        parts.append(article())
        parts += [boiler(r) for r in ("side", "share", "ad", "comment", "form", "notice", "nav") if chance(0.3)]
        if chance(0.8):
            parts.append(boiler("footer"))
        page = "".join(parts)
        if chance(0.3):
            page = f'<div class="{pick(["wrapper", "container", "page", "site", "row", "layout"])}">{page}</div>'
        b = blocks(f"<html><head><title>{word()}</title></head><body>{page}</body></html>")
        got = [(p, t.replace(" ☂", "").replace("☂", "").strip(), k) for p, t, k in b]
        keep = [i for i, x in enumerate(got) if x[1]]
        if keep:
            out.append(([(got[i][0], got[i][1], min(got[i][2], len(got[i][1]))) for i in keep], [int("☂" in b[i][1]) for i in keep]))
    return out


@functools.lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    """The labeller's weights: the same ones each time."""
    return train(training_pages())


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text) of each page: its article blocks in page order, a line each.

    Needs page_id, url and html; other columns are ignored. A null or empty page has the empty text; null and
    repeated ids are fine, each row is read by itself. Inside a block, white space is one space; character
    references are decoded.
    """
    p = model or weights()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in pieces(b, "html", 1 << 20):
                got = [blocks(h or "") for h in s.column(2).to_pylist()]
                text = ["\n".join(x[1] for x, k in zip(g, keep) if k) for g, keep in zip(got, label(p, got))]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1).cast(pa.string()), pa.array(text, pa.string())], schema=out)

    return mapped(pages, ["page_id", "url", "html"], run, "page_id bigint, url string, text string")
