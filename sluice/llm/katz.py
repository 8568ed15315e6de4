"""Language-model scores: a Katz backoff n-gram model (trigrams by default) with Good-Turing discounts.

Tokens are words of the lower-cased text and one end. Counts of each order are gathered over all training
documents, in tables that are partitioned by context; no table is ever whole on one machine.

Documents are turned into chunks once: rows that hold some hundred thousand tokens as codes into a
vocabulary of their own. What a chunk needs to know of the corpus it asks of the tables, order by order, one packed
message for each part of a table that it asks something; the parts add up what the chunks have counted and
answer in the order asked. So an n-gram that a chunk has a thousand times is sent once, and messages never
outnumber the distinct n-grams of the chunks: what is exchanged grows with the corpus, not with chunks x parts.

1. Tokens, by their hash: answered by a number for each token and its count in the corpus.
2. n-grams of each order n from 2, by context (n-1 numbers), so that a context is whole in a part; a context of
   as many tokens as a part has on average is dealt by its next token, too. Answered by counts, each context's total,
   and, where a chunk has asked for something that isn't in the corpus, the sums that backoff weights are made of.
3. A chunk's state after each order is written out and its predecessor dropped. The last gives the sums by document.

p(w | h) = d(c) c(hw) / c(h.) where c(hw) > 0, else alpha(h) p(w | h'), h' being h without its first word, down to
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), which sums to 1 over the V tokens and one unknown. alpha(h) is the mass that
discounts leave over the mass that p(. | h') gives to tokens not seen after h, so each context sums to 1, too; for
a context that the corpus doesn't have it is 1. A document starts after n - 1 start marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import U64, Scratch, cut, fold, mapped, mix, pieces, words

#: Tokens of a chunk, and of a part of a table, about.
CHUNK_TOKENS, PART_TOKENS = 600_000, 300_000
#: Contexts that may be dealt by their next token, at most, as their sums are sent to every task (some 60 bytes each).
MOST_HOT = 1 << 20
K = 5  # counts up to which Good-Turing discounts
_END = U64(0x5851F42D4C957F2D)
_START = U64(0xFFFFFFFFFFFF)
#: Sums of a context: tokens after it, n-grams by count 1..K, and the lower order's mass of what follows it.
SUMS = K + 2
_MSG = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_MSG_DDL = "part int, chunk bigint, blob binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("stats", pa.binary())])
_ANSWER_DDL = "chunk bigint, part int, blob binary, stats binary"
_STATE = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])
_STATE_DDL = "chunk bigint, blob binary"
#: The chunk that stands for a kept table among messages.
MODEL = -1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, integers by planes of their bytes, compressed where that is less."""
    head = ";".join(f"{a.dtype.str[1:]},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    raw = len(head).to_bytes(2, "little") + head + body
    small = zstandard.ZstdCompressor(level=3).compress(raw)
    return b"z" + small if len(small) < len(raw) else b"-" + raw


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    at = 2 + int.from_bytes(raw[:2], "little")
    out = []
    for spec in raw[2:at].decode().split(";"):
        kind, n = spec.split(",")
        n, size = int(n), np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


@dataclass(frozen=True)
class Model:
    """What every task knows: table parts, tokens of a part, training tokens, distinct ones, and discounts of each order from 2."""

    parts: int
    part_tokens: int
    tokens: float = 0.0
    distinct: float = 0.0
    discounts: tuple[tuple[float, ...], ...] = ()

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def hot(self, count: np.ndarray) -> np.ndarray:
        """Contexts that are dealt by their next token, too; the last one stands for the start of a document."""
        hot = count.astype(float) >= max(self.part_tokens, self.tokens / MOST_HOT)
        hot[-1] = True
        return hot


def chunks(docs: DataFrame, held: Column, size: int) -> DataFrame:
    """(chunk, n_tokens, blob): runs of documents as their ids, whether held out, token counts, vocabulary and codes."""
    out = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, have, n = TaskContext.get().partitionId() << 24, 0, [], 0

        def flush():
            ids, null, held_, sizes, toks = (np.concatenate(c) for c in zip(*have))
            codes, vocab = pd.factorize(toks)
            order = np.argsort(-np.bincount(codes), kind="stable")  # common tokens get low codes, which pack well
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            codes, vocab = rank[codes], vocab[order]
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([len(toks)]), pa.array([pack(ids, null, held_, sizes, vocab, codes)], pa.binary())], schema=out)

        for b in batches:
            for p in pieces(b, "text"):
                w = words(p.column(1), True)
                toks = np.insert(w.hashes(), w.first[1:], _END)  # one end after each document's words
                ids = p.column(0)
                have.append((ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), p.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), (w.counts + 1).astype(np.int64), toks))
                n += len(toks)
                if n >= size:
                    yield flush()
                    made, have, n = made + 1, [], 0
        if have:
            yield flush()

    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    return mapped(rows, ["doc_id", "text", "held"], run, "chunk bigint, n_tokens bigint, blob binary")


def _messages(part: np.ndarray, parts: int):
    """For each part that is asked something, which entries, in order."""
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
        yield int(part[order[a]]), order[a:b]


def _token_parts(vocab: np.ndarray, parts: int) -> np.ndarray:
    return (vocab % U64(parts)).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def ask_tokens(parts: int):
    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1)):
                _, _, held, sizes, vocab, codes = unpack(blob.as_py())
                count = np.bincount(codes[np.repeat(held, sizes) == 0], minlength=len(vocab)).astype(np.uint32)
                yield from _rows(_MSG, [(k, chunk, pack(vocab[i], count[i])) for k, i in _messages(_token_parts(vocab, parts), parts)]).to_batches()

    return run


def answer_tokens(parts: int, keep: bool):
    """Numbers tokens within their part, commonest first, and adds up counts; stats: training tokens and distinct ones."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        got = [unpack(x) for x in t["blob"].to_pylist()]
        inv, uniq = pd.factorize(np.concatenate([g[0] for g in got]))
        count = np.bincount(inv, np.concatenate([g[1] for g in got]), len(uniq)).astype(np.uint64)
        order = np.lexsort((uniq, -count.astype(np.int64)))
        rank = np.empty(len(uniq), np.uint64)
        rank[order] = np.arange(len(uniq), dtype=np.uint64)
        part = t["part"][0].as_py()
        rank = rank * U64(parts) + U64(part)
        rows, lo = [], 0
        for chunk, g in zip(t["chunk"].to_pylist(), got):
            at = inv[lo : lo + len(g[0])]
            lo += len(at)
            if chunk != MODEL:
                rows.append((chunk, part, pack(rank[at], count[at]), None))
        rows.append((MODEL, part, pack(uniq[count > 0], count[count > 0]) if keep else None, pack(np.array([0], np.uint64), np.array([[count.sum(), (count > 0).sum(), *[0] * (SUMS - 2)]], np.float64).ravel())))
        return _rows(_ANSWER, rows)

    return run


class Chunk:
    """A chunk's state: documents, codes, the corpus's numbers and counts of its tokens, and, by order from 2, what is known of its distinct n-grams.

    ``of[n]`` gives each token's n-gram, ``ctx[n]`` and ``last[n]`` each n-gram's context (an n-1-gram, or the
    start of a document, numbered after them) and last token, both in order of context.
    """

    def __init__(self, blob: bytes):
        self.ids, self.null, self.held, self.sizes, self.number, self.codes, *known = unpack(blob)
        self.count = known[0]
        self.counts, self.totals, self.alphas = known[1::3], known[2::3], known[3::3]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(self.held, self.sizes) == 0
        self.order = 1
        self.of, self.n, self.ctx, self.last = {1: self.codes.astype(np.int32)}, {1: len(self.number)}, {}, {}
        for _ in self.counts:
            self.extend()

    def extend(self) -> None:
        """The n-grams of the next order."""
        n, codes = self.order + 1, self.of[1]
        before = np.empty(len(codes), np.int64)
        before[1:] = self.of[n - 1][:-1]
        before[self.first] = self.n[n - 1]
        before *= self.n[1]
        before += codes
        key, of = np.unique(before, return_inverse=True)
        self.of[n], self.n[n], self.order = of.astype(np.int32), len(key), n
        self.ctx[n], self.last[n] = (key // self.n[1]).astype(np.int32), (key % self.n[1]).astype(np.int32)

    def blob(self, *more: np.ndarray) -> bytes:
        return pack(self.ids, self.null, self.held, self.sizes, self.number, self.codes, self.count, *(x for c in zip(self.counts, self.totals, self.alphas) for x in c), *more)

    def known(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts in the corpus of the n-grams, and of their contexts (0 for tokens)."""
        return (self.count, np.zeros(self.n[1], np.uint64)) if n == 1 else (self.counts[n - 2], self.totals[n - 2][self.ctx[n]])

    def context(self, n: int) -> list[np.ndarray]:
        """The numbers of the n-grams' tokens by position, and those of the start of a document last."""
        if n == 1:
            return [np.append(self.number, _START)]
        return [*(np.append(c[self.ctx[n]], _START) for c in self.context(n - 1)), np.append(self.number[self.last[n]], _START)]

    def parts(self, n: int, m: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The part of each n-gram of order n, which contexts are hot, and the contexts' numbers."""
        names = self.context(n - 1)
        key = fold_numbers(names)
        hot = m.hot(np.append(self.known(n - 1)[0], 0))
        c = self.ctx[n]
        part = mix(np.where(hot[c], key[c] * U64(0x9E3779B97F4A7C15) + self.number[self.last[n]], key[c])) % U64(m.parts)
        return part.astype(np.int64), hot, names

    def lower(self, n: int) -> np.ndarray:
        """For each n-gram, the one without its first token."""
        out = np.empty(self.n[n], np.int32)
        out[self.of[n]] = self.of[n - 1]
        return out

    def probabilities(self, n: int, m: Model) -> np.ndarray:
        """Katz probabilities of the distinct n-grams, order by order."""
        if n == 1:
            return m.unigram(self.count)
        d, c = np.array(m.discounts[n - 2]), self.ctx[n]
        count, total, alpha = self.counts[n - 2], self.totals[n - 2], self.alphas[n - 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(count > 0, d[np.minimum(count, K + 1)] * count / total[c], alpha[c] * self.probabilities(n - 1, m)[self.lower(n)])


def fold_numbers(names: list[np.ndarray]) -> np.ndarray:
    key = names[0]
    for c in names[1:]:
        key = mix(key * U64(0xC2B2AE3D27D4EB4F) + c)
    return key


def _runs(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of n-grams that are in order of them, and how many n-grams each has."""
    at = np.flatnonzero(np.diff(ctx, prepend=-1))
    return ctx[at], np.diff(np.append(at, len(ctx)))


def first_state(parts: int):
    """Chunks with the answers to their tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _STATE.empty_table()
        ids, null, held, sizes, vocab, codes = unpack(left["blob"][0].as_py())
        number, count = np.zeros(len(vocab), np.uint64), np.zeros(len(vocab), np.uint64)
        asked = dict(_messages(_token_parts(vocab, parts), parts))
        for k, b in zip(right["part"].to_pylist(), right["blob"].to_pylist()):
            number[asked[k]], count[asked[k]] = unpack(b)
        return _rows(_STATE, [(left["chunk"][0].as_py(), pack(ids, null, held, sizes, number, codes, count))])

    return run


def ask(n: int, m: Model):
    """Messages of a chunk's n-grams: contexts (numbers, whether hot, fan-out, total of the lower order's context), then tokens, training counts and the lower order's counts."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1)):
                s = Chunk(blob.as_py())
                s.extend()
                train = np.bincount(s.of[n][s.train], minlength=s.n[n]).astype(np.uint32)
                part, hot, names = s.parts(n, m)
                r, t = (x[s.lower(n)] for x in s.known(n - 1))
                r = np.where(train > 0, r, 0).astype(np.uint64)
                at = np.zeros(len(hot), np.uint64)
                at[s.ctx[n]] = t  # the same for all n-grams of a context
                rows = []
                for k, i in _messages(part, m.parts):
                    a, fan = _runs(s.ctx[n][i])
                    rows.append((k, chunk, pack(*(c[a] for c in names), hot[a].astype(np.uint8), fan.astype(np.uint32), at[a], s.number[s.last[n][i]], train[i], r[i])))
                yield from _rows(_MSG, rows).to_batches()

    return run


def answer(n: int, m: Model, keep: bool):
    """Counts of n-grams and sums of contexts; stats: n-grams by count 1..K+1, and this part's sums of hot contexts."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        part, ids = t["part"][0].as_py(), t["chunk"].to_pylist()
        got = [unpack(x) for x in t["blob"].to_pylist()]
        names = [np.concatenate([g[j] for g in got]) for j in range(n - 1)]
        hot_, fan, low_total = (np.concatenate([g[n - 1 + j] for g in got]) for j in range(3))
        token, train, r = (np.concatenate([g[n + 2 + j] for g in got]) for j in range(3))
        asked, au = pd.factorize(fold_numbers(names))  # by message and context
        ai = np.repeat(asked, fan)
        bi, _ = pd.factorize(token)
        inv, key = pd.factorize(ai.astype(np.int64) * (bi.max() + 1) + bi)
        count = np.bincount(inv, train, len(key)).astype(np.int64)
        at = np.zeros(len(key), np.int64)
        on = np.flatnonzero(train > 0)
        at[inv] = np.arange(len(inv))
        at[inv[on]] = on  # an entry that knows the lower order's counts
        seen = np.flatnonzero(count)
        low = r[at[seen]].astype(float)
        if n == 2:
            mass = m.unigram(low)
        else:
            mass = np.array(m.discounts[n - 3])[np.minimum(low, K + 1).astype(int)] * low / np.repeat(low_total, fan)[at[seen]]
        ctx = ai[at]
        sums = np.zeros((len(au), SUMS))
        sums[:, 0] = np.bincount(ctx, count, len(au))
        for c in range(1, K + 1):
            sums[:, c] = np.bincount(ctx[count == c], minlength=len(au))
        sums[:, K + 1] = np.bincount(ctx[seen], mass, len(au))
        hot = np.zeros(len(au), bool)
        hot[asked] = hot_ == 1
        rows, lo, clo = [], 0, 0
        for chunk, g in zip(ids, got):
            hi, chi = lo + len(g[-1]), clo + len(g[0])
            if chunk != MODEL:
                c = asked[clo:chi]
                own = count[inv[lo:hi]]
                want = needs(own, np.repeat(np.arange(chi - clo), g[n]), sums[c, 0], hot[c])
                s = sums[c[want]]
                total = np.where(hot[c], 0, adjusted(sums[c])).astype(np.uint64)
                rows.append((chunk, part, pack(own.astype(np.uint64), total, *(s[:, j].astype(np.uint64) for j in range(1, K + 1)), s[:, K + 1]), None))
            lo, clo = hi, chi
        by_count = [float((count == c).sum()) for c in range(1, K + 2)]
        h = np.flatnonzero(hot & (sums[:, 0] > 0))
        stats = pack(np.append(U64(0), au[h].astype(np.uint64)), np.vstack([[*by_count, *[0] * (SUMS - K - 1)], sums[h]]).ravel())
        table = None
        if keep:  # as the one message that counts all that is counted here
            use = seen[np.argsort(ctx[seen], kind="stable")]
            a, fan_ = _runs(ctx[use])
            of = np.zeros(len(au), np.int64)
            of[asked] = np.arange(len(asked))
            table = pack(*(c[of[a]] for c in names), hot[a].astype(np.uint8), fan_.astype(np.uint32), low_total[of[a]], token[at[use]], count[use].astype(np.uint32), r[at[use]])
        rows.append((MODEL, part, table, stats))
        return _rows(_ANSWER, rows)

    return run


def needs(count: np.ndarray, ctx: np.ndarray, total: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Contexts whose sums an answer holds: known ones of which something was asked that the corpus doesn't have, and not hot ones."""
    some = np.zeros(len(total), bool)
    some[ctx[count == 0]] = True
    return np.flatnonzero(some & (total > 0) & ~hot)


def adjusted(sums: np.ndarray) -> np.ndarray:
    """Totals of contexts; one whose counts are all large lends one count."""
    return sums[:, 0] + ((sums[:, 0] > 0) & (sums[:, 1 : K + 1].sum(1) == 0))


def weights(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts: the mass that discounts leave over the lower order's mass of what wasn't seen."""
    total = adjusted(sums)
    left = (sums[:, 1 : K + 1] * np.arange(1, K + 1) * (1 - d[1 : K + 1])).sum(1) + (total > sums[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, left / total / (1 - sums[:, K + 1]), 1.0)


def discounts(by_count: np.ndarray) -> np.ndarray:
    """d(0), d(1), ..., d(K), and 1 for what is more; where Good-Turing gives no share between 0 and 1, half a count is taken off."""
    d = np.ones(K + 2)
    n = by_count
    over = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - over) / (1 - over) if n[r - 1] and over < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


def next_state(n: int, m: Model, hot_key: np.ndarray, hot_sums: np.ndarray):
    """Chunks with the answers to their n-grams; ``m`` has this order's discounts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _STATE.empty_table()
        s = learnt(left["blob"][0].as_py(), zip(right["part"].to_pylist(), right["blob"].to_pylist()), n, m, hot_key, hot_sums)
        return _rows(_STATE, [(left["chunk"][0].as_py(), s.blob())])

    return run


def learnt(blob: bytes, answers, n: int, m: Model, hot_key: np.ndarray, hot_sums: np.ndarray) -> Chunk:
    s = Chunk(blob)
    s.extend()
    part, hot, names = s.parts(n, m)
    d = np.array(m.discounts[n - 2])
    count, total, alpha = np.zeros(s.n[n], np.uint64), np.zeros(len(hot), np.uint64), np.ones(len(hot))
    asked = dict(_messages(part, m.parts))
    for k, b in answers:
        c, t, *sums = unpack(b)
        i = asked[k]
        count[i] = c
        a, fan = _runs(s.ctx[n][i])
        own = ~hot[a]
        total[a[own]] = t[own]
        want = needs(c, np.repeat(np.arange(len(a)), fan), t, hot[a])
        full = np.column_stack([np.zeros(len(want)), *sums]) if len(want) else np.zeros((0, SUMS))
        full[:, 0] = t[want] - (full[:, 1 : K + 1].sum(1) == 0)  # the total before it was adjusted
        alpha[a[want]] = weights(full, d)
    h = np.flatnonzero(hot)
    if len(hot_key):
        key = fold_numbers([c[h] for c in names])
        i = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
        found = np.where((hot_key[i] == key)[:, None], hot_sums[i], 0)
        total[h], alpha[h] = adjusted(found), weights(found, d)
    s.counts.append(count), s.totals.append(total), s.alphas.append(alpha)
    return s


_SCORES = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_DDL = "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scores(s: Chunk, m: Model) -> pa.Table:
    n = len(s.sizes)
    doc = np.repeat(np.arange(n), s.sizes)
    logs = np.log10(s.probabilities(s.order, m))[s.of[s.order]]
    base, known = np.log10(m.unigram(s.count))[s.codes], (s.count > 0)[s.codes]
    return pa.table([
        pa.array(s.ids, mask=s.null.astype(bool)), pa.array(s.held.astype(bool)), pa.array(s.sizes),
        pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, logs, n)),
    ], schema=_SCORES)


def last_scores(n: int, m: Model, hot_key: np.ndarray, hot_sums: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORES.empty_table()
        return scores(learnt(left["blob"][0].as_py(), zip(right["part"].to_pylist(), right["blob"].to_pylist()), n, m, hot_key, hot_sums), m)

    return run


def summed(answers: DataFrame) -> dict[int, np.ndarray]:
    """The parts' stats, added up by key: MOST_HOT + 1 of them at most."""
    names = [f"s{j}" for j in range(SUMS)]

    def run(batches):
        for b in batches:
            for x in b.column(0):
                key, sums = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c) for c in sums.reshape(-1, SUMS).T)], ["key", *names])

    rows = mapped(answers.where("stats IS NOT NULL"), ["stats"], run, "key bigint, " + ", ".join(f"{c} double" for c in names))
    return {r[0]: np.array(r[1:]) for r in rows.groupBy("key").agg(*[F.sum(c) for c in names]).collect()}


def _exchanged(c: DataFrame, m: Model, order: int, tmp: Scratch, use: str | None = None, save: str | None = None) -> DataFrame:
    spark = c.sparkSession

    def answered(n: int, asks: DataFrame, fn) -> DataFrame:
        if use:
            asks = asks.union(spark.read.parquet(f"{use}/order-{n}").select("part", F.lit(MODEL).cast("bigint").alias("chunk"), "blob"))
        got = tmp.keep(f"answers-{n}", asks.groupBy("part").applyInArrow(fn, _ANSWER_DDL))
        if save:
            got.where((F.col("chunk") == MODEL) & F.col("blob").isNotNull()).select("part", "blob").write.parquet(f"{save}/order-{n}")
        return got

    def met(state: DataFrame, answers: DataFrame):
        return state.select("chunk", "blob").groupBy("chunk").cogroup(answers.where(F.col("chunk") != MODEL).select("chunk", "part", "blob").groupBy("chunk"))

    got = answered(1, c.select("chunk", "blob").mapInArrow(ask_tokens(m.parts), _MSG_DDL), answer_tokens(m.parts, bool(save)))
    total = summed(got).get(0, np.zeros(SUMS))
    m = Model(m.parts, m.part_tokens, float(total[0]), float(total[1]))
    state = tmp.keep("state-1", met(c, got).applyInArrow(first_state(m.parts), _STATE_DDL))
    tmp.drop("chunks", "answers-1")
    out = state.mapInArrow(_score_chunks(m), _SCORES_DDL)
    for n in range(2, order + 1):
        got = answered(n, state.mapInArrow(ask(n, m), _MSG_DDL), answer(n, m, bool(save)))
        hot = summed(got)
        d = discounts(hot.pop(0, np.zeros(SUMS))[: K + 1])
        m = Model(m.parts, m.part_tokens, m.tokens, m.distinct, (*m.discounts, tuple(d.tolist())))
        keys = np.array(list(hot), np.int64).view(np.uint64)
        at = np.argsort(keys)
        hot_key, hot_sums = keys[at], np.array(list(hot.values())).reshape(-1, SUMS)[at]
        if n == order:
            out = met(state, got).applyInArrow(last_scores(n, m, hot_key, hot_sums), _SCORES_DDL)
        else:
            state = tmp.keep(f"state-{n}", met(state, got).applyInArrow(next_state(n, m, hot_key, hot_sums), _STATE_DDL))
            tmp.drop(f"state-{n - 1}", f"answers-{n}")
    out = out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(m.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score")
    out = cut(out)  # a row a document
    tmp.drop()
    return out


def _score_chunks(m: Model):
    def run(batches):
        for b in batches:
            for blob in b.column(b.schema.get_field_index("blob")):
                yield from scores(Chunk(blob.as_py()), m).to_batches()

    return run


def score_documents(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS, order: int = 3, save: str | None = None, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from the rows that ``held`` doesn't mark. Needs doc_id and text; other columns are ignored. A null
    text is an empty one: its end is its only token. A very long text is a chunk of its own, held whole by one
    task. Null and repeated ids are fine, each row is scored by itself; rows with a null id are learnt from. An
    empty table gives no rows; where all is held out, train_tokens is 0. ``chunk_tokens`` and
    ``part_tokens`` bound the memory of a task (some 300 bytes a token). ``save``: a folder for the model's tables, for ``score_with``.
    """
    tmp = Scratch(docs.sparkSession)
    c = tmp.keep("chunks", chunks(docs, held, chunk_tokens))
    size = c.agg(F.sum("n_tokens")).first()[0] or 0
    m = Model(max(1, -(-size // part_tokens)), part_tokens)
    if save:
        docs.sparkSession.createDataFrame([(m.parts, m.part_tokens, order)], "parts int, part_tokens bigint, n int").write.parquet(f"{save}/shape")
    return _exchanged(c, m, order, tmp, save=save)


def score_with(docs: DataFrame, at: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The columns of ``score_documents`` for documents that are all new to a model saved in the folder ``at``."""
    parts, part_tokens, order = docs.sparkSession.read.parquet(f"{at}/shape").first()
    tmp = Scratch(docs.sparkSession)
    c = tmp.keep("chunks", chunks(docs, F.lit(True), chunk_tokens))
    return _exchanged(c, Model(parts, part_tokens), order, tmp, use=at)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that the model is never learnt from: crc32 of the id as text mod 5 is 1."""
    return fold(doc_id, 5) == 1
