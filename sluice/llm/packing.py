"""Best-fit packing of token sequences by minimum bin slack.

Lengths lie between 1 and the capacity, so however many documents there are, what is to pack is a
histogram of at most ``capacity`` counts. On it, a bin is filled by subset-sum dynamic programming: the
longest length left opens the bin, a bitset holds the sums that lengths still available can reach, and
the fullest feasible combination closes it. That combination is taken as often as the counts allow, so
each one uses up a length or leaves too few of it: combinations number a few thousand at most, and so
does the plan that is broadcast. Documents find their places by their rank among pieces of their length,
counted within partitions and offset by partition counts, never by gathering a length's pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, mapped, maybe_broadcast

_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("_part", pa.int32()), ("_rank", pa.int64())])
_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids binary, _part int, _rank bigint"
#: White space of Unicode, as the tokenizer's pattern has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows of the table of partition counts up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of tokenized units that a worker remembers, about, and characters of the longest one that it does.
CACHE, LONGEST = 96 << 20, 64
#: Characters up to which the quicker encoder reads a text whole; in longer ones, long runs of spaces would be too much for its pattern.
AT_ONCE = 1 << 16


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file by bytes, if its ids are in order of its merges; else None."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b) for a, b in merges]
    if model.get("type") != "BPE" or None in made or made != sorted(made):
        return None
    return {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if all(c in char for c in t)}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, whole, or long ones unit by unit with a cache.

    A unit is a run of non-space with the space before it, or a run of spaces; the tokenizer's own
    pattern never crosses these, so the units' ids joined are the text's. Ids are those of the tokenizer
    file; where it is a byte-level BPE with ids in order of merges, a quicker encoder with the same
    merges makes them, and the tokenizer itself where not. As the tokenizer does, a special token's
    text is that token wherever it stands, and the texts around it are encoded by themselves.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.unit = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t for t in file.get("added_tokens", [])}
        plain = not any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")) and not file.get("normalizer")
        ranks = _byte_ranks(path) if plain else None
        self.whole = None
        if ranks:
            quick = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in added}, special_tokens={})
            self.ids = lambda x: quick.encode_to_numpy(x, disallowed_special=())
        else:  # texts as they are
            t = Tokenizer.from_file(path)
            self.whole = lambda x: t.encode(x, add_special_tokens=False).ids
        self.special = {x: np.array([t["id"]], "<u4").tobytes() for x, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda x: [x]
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        """The units of a text; special tokens are units of their own."""
        if not any(x in text for x in self.special):
            return self.unit(text)
        return [u for x in self.split(text) for u in ([x] if x in self.special else self.unit(x))]

    def encode(self, texts: list[str], chars: int = 1 << 20) -> Iterator[bytes]:
        """Each text's ids."""
        for t in texts:
            if self.whole:
                yield np.array(self.whole(t), dtype="<u4").tobytes()
            elif len(t) > AT_ONCE:
                yield from self.by_units([t], chars)
            elif any(x in t for x in self.special):
                yield b"".join([self.special.get(x) or self.ids(x).astype("<u4", copy=False).tobytes() for x in self.split(t)])
            else:
                yield self.ids(t).astype("<u4", copy=False).tobytes()

    def by_units(self, texts: list[str], chars: int = 1 << 20) -> Iterator[bytes]:
        """Each text's ids, unit by unit."""
        as_bytes = lambda ids: np.array(ids, dtype="<u4").tobytes()
        lo = 0
        while lo < len(texts):
            hi, n = lo + 1, len(texts[lo])
            while hi < len(texts) and n + len(texts[hi]) <= chars:
                n += len(texts[hi])
                hi += 1
            units = [self.units(t) for t in texts[lo:hi]]
            if self.held > CACHE:  # keep what this run needs, which has the common ones
                self.seen = {u: self.seen[u] for u in set().union(*units) if u in self.seen}
                self.held = sum(4 * len(u) + len(v) + 200 for u, v in self.seen.items())
            here = dict(self.special)
            for u in set().union(*units).difference(self.seen, here):
                ids = as_bytes(self.ids(u))
                if len(u) > LONGEST:
                    here[u] = ids
                else:
                    self.seen[u] = ids
                    self.held += 4 * len(u) + len(ids) + 200
            for us in units:
                yield b"".join([here[u] if u in here else self.seen[u] for u in us])
            lo = hi


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, capacity: int, vocab: str | None, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids (then ``end_id``): doc_id, piece, start, length, ids (binary, u32le), and their rank in their partition."""
    path = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for d, ids in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids += tail
                    n = len(ids) // 4
                    at, k = 0, 0
                    to = n % capacity or capacity  # only the first piece may be shorter
                    while at < n:
                        seen[to - at] += 1
                        for c, v in zip(cols, (d, k, at, to - at, ids[4 * at : 4 * to], seen[to - at] - 1)):
                            c.append(v)
                        at, to, k = to, to + capacity, k + 1
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:5], _OUT)), pa.array(np.full(len(cols[0]), part, np.int32)), pa.array(cols[5], pa.int64())], schema=_OUT)

    return mapped(docs, ["doc_id", "text"], run, _DDL)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the lengths available, the combination with the longest one that fills the bin most; longer lengths first among equals."""
    top = max(counts)
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before
    sums, room = 1, capacity - top
    within = (1 << (room + 1)) - 1
    for n in sorted(counts, reverse=True):
        left = min(counts[n] - (n == top), room // n if n else 0)
        take = 1
        while left > 0:
            k = min(take, left)
            steps.append((n, k, sums))
            sums |= (sums << (k * n)) & within
            left -= k
            take *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    used = {top: 1}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places by length: (length, first rank, end rank, copies in a bin, first bin, offset in the bin)."""
    counts = {n: c for n, c in histogram.items() if c}
    given = dict.fromkeys(counts, 0)
    out, bins = [], 0
    while counts:
        use = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in use.items())
        at = 0
        for n in sorted(use, reverse=True):
            k = use[n]
            out.append((n, given[n], given[n] + k * times, k, bins, at))
            given[n] += k * times
            at += k * n
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        bins += times
    return out


def pack(docs: DataFrame, capacity: int = 2048, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (binary, little-endian u32), sequence_id, offset.

    Needs doc_id and text; other columns are ignored. A null text is an empty one and is its end id
    alone. Null and repeated doc_ids are fine: each row is packed by itself. A document longer than the
    capacity is cut from its end into full pieces, so that its first piece may be shorter. An empty
    table gives no rows. ``vocab`` is the tokenizer's file, the public 50k byte-level one if None.
    """
    spark = docs.sparkSession
    rows = cut(tokenized(docs, capacity, vocab, end_id))
    counts = cut(rows.groupBy("_part", "length").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    ranks = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).select("_part", "length", "_before")
    ranks = maybe_broadcast(ranks, counts.count(), BROADCAST_ROWS)
    places = F.broadcast(spark.createDataFrame(plan(histogram, capacity) or [(0, 0, 0, 1, 0, 0)], "length bigint, _lo bigint, _hi bigint, _k bigint, _bin bigint, _at bigint"))
    at = rows.join(ranks, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    at = at.join(places, (at["length"] == places["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(places["length"])
    slot = F.col("_rank") - F.col("_lo")
    return at.select("doc_id", "piece", "start", "length", "ids", (F.col("_bin") + F.expr("(_rank - _lo) div _k")).alias("sequence_id"), (F.col("_at") + slot % F.col("_k") * F.col("length")).alias("offset"))
