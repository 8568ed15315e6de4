"""SimHash near-duplicate groups, found with covering locality-sensitive hashing.

Every bit position gets a non-zero vector of r+1 bits. For each of the 2**(r+1)-1 non-zero v, a mask
keeps the positions whose vector has an odd product with v. The vectors of r differing positions span
at most r dimensions, so some v is orthogonal to all of them: under its mask the two fingerprints agree.
Each pair within the radius thus shares a bucket of some table, for certain.

Only distinct fingerprints are hashed. A bucket's members are first linked to three pivots of the bucket,
components are taken, and only members outside their bucket's largest component are compared with the
bucket's other components. A pair within the radius lies either
in one component or in such a comparison, so no link between groups is lost.

Fingerprints within a radius say little about pairs of a shingle similarity of 0.8: most differ in more bits.
Where one document of a group is kept, groups are links of exact Jaccard similarity: candidates come from the
fingerprints and from bands of least hashes, and each pair is compared by its sets of shingles: those of a group's
members with its pivots, then, as above, all pairs of a group that are not in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import U64, cut, gram_starts, grams, mapped, maybe_broadcast, mix, pieces, record, words
from sluice.llm.graph import components

_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LANES = np.uint64(0x0001000100010001)


def _bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run h[first[i]:first[i+1]] (none empty), how often each of the 64 bits is set."""
    out = np.empty((len(first) - 1, 64), np.int64)
    sizes = np.diff(first)
    for j in range(16):  # four 16-bit counters in a word; runs too long for them are counted below
        s = np.add.reduceat((h >> np.uint64(j)) & _LANES, first[:-1])
        for lane in range(4):
            out[:, 16 * lane + j] = (s >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    for i in np.flatnonzero(sizes > 0xFFFF):
        run = h[first[i] : first[i + 1]]
        out[i] = [int(((run >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    return out


def fingerprints(arr: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """Signed 64-bit SimHashes of the texts: a bit is set where over half of the shingles' XXH64 have it set."""
    w = words(arr, lower=True)
    n = len(w.first) - 1
    fp = np.zeros(n, np.uint64)
    if not len(w.start):
        return fp.view(np.int64)
    word = np.zeros(len(w.data), bool)
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    word = np.cumsum(edge[:-1]).astype(bool)
    gap = np.zeros(len(w.data) + 1, bool)
    gap[w.end] = True  # the white space after a word stands for the space between words
    keep = word | gap[:-1]
    text = np.where(word, w.data, np.uint8(0x20))[keep].tobytes()
    at = np.cumsum(keep) - 1
    s, e = at[w.start], at[w.end - 1] + 1
    counts = w.counts
    full = gram_starts(w.first, shingle)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    lo = np.concatenate([s[full], s[w.first[short]]])
    hi = np.concatenate([e[full + shingle - 1], e[w.first[short + 1] - 1]])
    f = xxhash.xxh64_intdigest
    h = np.fromiter((f(text[a:b], seed) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
    size = np.maximum(counts - shingle + 1, 0)
    long = np.flatnonzero(size)
    if len(long):
        ends = np.concatenate([[0], np.cumsum(size[long])])
        on = _bit_sums(h[: ends[-1]], ends) * 2 > size[long][:, None]
        fp[long] = (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    fp[short] = h[len(full) :]
    return fp.view(np.int64)


def masks(radius: int) -> list[int]:
    """The covering masks of 64-bit fingerprints, as signed longs."""
    top = 1 << (radius + 1)
    vec = [1 + i * (top - 1) // 64 if top > 64 else 1 + i % (top - 1) for i in range(64)]
    out = []
    for v in range(1, top):
        m = sum(1 << i for i in range(64) if bin(vec[i] & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def linked(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, component) of the distinct fingerprints ``nodes.fp`` that have a neighbour within the radius."""
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))])
    rows = nodes.select("fp", F.explode(keys).alias("k"))
    shared = rows.groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min_by("fp", F.xxhash64("fp")).alias("mid")).where("lo != hi")
    shared = cut(rows.join(shared, "k"))
    pivot = [shared.where((F.col("fp") != F.col(p)) & near("fp", p)).select(F.col("fp").alias("a"), F.col(p).alias("b")) for p in ("lo", "hi", "mid")]
    first = cut(components(pivot[0].union(pivot[1]).union(pivot[2])))

    labelled = shared.select("k", "fp").join(first, F.col("fp") == F.col("node"), "left").select("k", "fp", F.coalesce("component", "fp").alias("c"))
    parts = labelled.groupBy("k", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("k").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main")).where("parts > 1").select("k", "main")
    mixed = cut(labelled.join(mixed, "k"))
    a, b = (mixed.select("k", F.col("fp").alias(f"fp{x}"), F.col("c").alias(x), F.col("main").alias(f"m{x}")) for x in "ab")
    cross = cut(
        a.where("a != ma").join(b, "k").where((F.col("a") != F.col("b")) & near("fpa", "fpb")).select("a", "b").distinct()
    )
    if cross.isEmpty():
        return first
    second = cut(components(cross).withColumnsRenamed({"node": "c", "component": "c2"}))
    ends = first.union(cross.select(F.col("a").alias("node"), F.col("a").alias("component"))).union(cross.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return ends.distinct().join(second, F.col("component") == F.col("c"), "left").select("node", F.coalesce("c2", "component").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id (the least doc_id of its group).

    Words are runs of non-white-space after lower-casing A-Z; fewer words than a shingle make one shingle,
    and no word at all (a null or empty text) the fingerprint 0, which links like any other. Other columns
    are ignored. Rows with a null doc_id take part and get their group's least known id, or null if it has
    none; repeated rows each come back. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                yield record(_OUT, p.column(0), fingerprints(p.column(1), shingle, seed))

    fps = cut(mapped(docs, ["doc_id", "text"], run, "doc_id bigint, fp bigint"))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked_ = linked(classes.select("fp"), radius)
    labelled = classes.join(linked_, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = cut(labelled.groupBy("c").agg(F.min("least").alias("component_id")))  # cut, so that a large group's join can be split
    by_fp = cut(labelled.select("fp", "c").join(least, "c").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Least hashes of a band and bands of a document: a pair of similarity 0.8 shares one at 0.9996, of 0.9 at 1 - 1e-8.
BAND, BANDS = 5, 20
#: Rows (a few numbers each) of a table of keys up to which it is broadcast to where texts are read; beyond, the join shuffles the texts.
#: A million such rows held 310 MB of the driver's heap, without them it was 125.
BROADCAST_KEYS = 200_000
#: Pairs that are compared in a block, on average.
BLOCK_PAIRS = 4_000
#: Longs of a sketch (four bits of each least hash), and in how many of the least hashes two may differ to be compared: those
#: of a pair of similarity 0.8 differ in 18.8 +- 3.9, of 0.7 in 28 +- 4.5, of 0.6 in 37.5 +- 4.8.
SKETCH, APART = -(-BAND * BANDS // 16), 33
#: The same of finer sketches, which only texts get that three pivots leave: 75 +- 7.8 of 400 at 0.8, 112 +- 9 at 0.7, 131 +- 9.4 at 0.65.
FINE, FINE_APART = 25, 104
_SETS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def shingles(arr: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts, and where each text's begin; fewer words than a shingle make one shingle."""
    w = words(arr, lower=True)
    h, counts = w.hashes(), w.counts
    at = gram_starts(w.first, shingle) if len(h) else np.zeros(0, np.int64)
    doc, g = w.doc()[at], grams(h, shingle)[at]
    for c in range(1, shingle):
        short = np.flatnonzero(counts == c)
        if len(short):
            doc, g = np.concatenate([doc, short]), np.concatenate([g, grams(h, c)[w.first[short]] ^ U64(c)])
    order = np.argsort(doc, kind="stable")
    return g[order], np.searchsorted(doc[order], np.arange(len(counts) + 1))


def _set_ids(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's shingles with their counts; 0 for none."""
    c = np.zeros(len(g) + 1, U64)
    np.cumsum(mix(g + U64(0x9E3779B97F4A7C15)), out=c[1:])
    return mix(c[first[1:]] - c[first[:-1]]).view(np.int64)


def _distinct(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different values each text's shingles have."""
    return np.fromiter((len(np.unique(g[a:z])) for a, z in zip(first[:-1].tolist(), first[1:].tolist())), np.int32, len(first) - 1)


def _bands(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BAND least hashes, BANDS of them for each run g[first[i]:first[i+1]] (none empty), and the runs' sketches."""
    draw = mix(np.arange(1, 2 * BAND * BANDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)).reshape(2, BANDS, BAND)
    out, sketch = np.zeros((len(first) - 1, BANDS), U64), np.zeros((len(first) - 1, SKETCH), U64)
    for t in range(BANDS):
        for j in range(BAND):
            low = np.minimum.reduceat((g ^ draw[0, t, j]) * (draw[1, t, j] | U64(1)), first[:-1])
            out[:, t] = mix(out[:, t] * U64(0xC2B2AE3D27D4EB4F) + low)
            i = t * BAND + j
            sketch[:, i // 16] |= (mix(low) & U64(15)) << U64(4 * (i % 16))
    return out.view(np.int64), sketch.view(np.int64)


def _fine(g: np.ndarray) -> np.ndarray:
    """The finer sketch of a set of shingles."""
    out = np.zeros(FINE, U64)
    if len(g):
        draw = mix(np.arange(1, 32 * FINE + 1, dtype=U64) * U64(0xA0761D6478BD642F))
        for j in range(16 * FINE):
            out[j // 16] |= (mix(((g ^ draw[2 * j]) * (draw[2 * j + 1] | U64(1))).min()) & U64(15)) << U64(4 * (j % 16))
    return out.view(np.int64)


def _pivots(members: DataFrame, group: str, similarity: float) -> DataFrame:
    """(a, b): members (sid, n, sketch) of a group with three of it, those that come first by three hashes, where they can be similar."""
    one = F.struct("sid", "n", "sketch")
    few = members.groupBy(group).agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.array(*[F.min_by(one, F.xxhash64(F.lit(i), F.col("sid"))) for i in range(3)]).alias("pivots")).where("lo != hi")
    met = members.join(few.select(group, "pivots"), group).select(one.alias("m"), "pivots")
    near = F.filter("pivots", lambda p: (p["sid"] != F.col("m.sid")) & _may(p, F.col("m"), similarity))
    return met.select(F.col("m.sid").alias("a"), F.explode(F.transform(near, lambda p: p["sid"])).alias("b"))


def _apart(x: Column, y: Column, longs: int) -> Column:
    """Of how many least hashes two sketches hold different bits."""
    out = F.lit(0)
    for i in range(longs):
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        out = out + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _may(x: Column, y: Column, similarity: float) -> Column:
    """Whether two members (sid, n, sketch) can have the similarity, by the sizes of their sets (for certain) and by their sketches."""
    return (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"])) & (_apart(x["sketch"], y["sketch"], SKETCH) <= APART)


def _mixed(members: DataFrame, group: str, component: DataFrame) -> DataFrame:
    """(group, m, c, main): the members of groups that are in several components so far, theirs and the group's largest one."""
    at = members.join(component, F.col("sid") == F.col("node"), "left").select(group, F.struct("sid", "n", "sketch").alias("m"), F.coalesce("component", "sid").alias("c"))
    parts = at.groupBy(group, "c").agg(F.count("*").alias("size"))
    mixed = parts.groupBy(group).agg(F.count("*").alias("parts"), F.max_by("c", F.struct("size", "c")).alias("main")).where("parts > 1").select(group, "main")
    return cut(at.join(mixed, group))


def _rest(mixed: DataFrame, group: str, finer: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of members of a group that are in different components, but those that cannot be similar by their sketches and finer ones (sid, fine).

    Of a group's largest component, members meet those outside it only; each pair outside it meets once.
    """
    mixed = mixed.join(finer.withColumnRenamed("sid", "id"), F.col("id") == F.col("m.sid")).select(group, "m", "fine", "c", "main")
    x, y = (mixed.select(group, *[F.col(c).alias(c + i) for c in ("m", "fine", "c", "main")]) for i in "xy")
    once = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("mainy")) | (F.col("mx.sid") < F.col("my.sid")))
    may = _may(F.col("mx"), F.col("my"), similarity) & (_apart(F.col("finex"), F.col("finey"), FINE) <= FINE_APART)
    return x.where("cx != mainx").join(y, group).where(once & may).select(F.col("mx.sid").alias("a"), F.col("my.sid").alias("b"))


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(doc_id, th, component): classes of the rows with an id (by it and xxhash64 of the text), linked by pairs whose sets of shingles have the Jaccard similarity.

    Candidates are texts whose fingerprints link, and texts with a common band. Those of such a group first meet three
    of it, the same ones in whichever groups they are; then whatever of a group is still in another component than its
    largest one meets all of the group that isn't in its own. Pairs in one component need no comparison. Pairs whose
    set sizes or sketches are too far apart for the similarity are dropped before any set is read.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("th"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                g, first = shingles(p.column(1), shingle)
                some = np.flatnonzero(np.diff(first))
                off = np.zeros(p.num_rows + 1, np.int32)
                off[some + 1] = BANDS
                keys, sketch = _bands(g, np.append(first[some], len(g))) if len(some) else np.zeros((2, 0), np.int64)
                lists = lambda wide, flat: pa.ListArray.from_arrays(pa.array(np.cumsum(off // BANDS * wide, dtype=np.int32)), pa.array(flat.ravel()))  # noqa: B023, E731
                yield record(_SETS, p.column(0), p.column(2), _set_ids(g, first), _distinct(g, first), fingerprints(p.column(1), shingle, 42), lists(BANDS, keys), lists(SKETCH, sketch))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                g, first = shingles(p.column(1), shingle)
                of = [np.unique(g[a:z]).view(np.int64) for a, z in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(of, pa.list_(pa.int64()))], ["sid", "s"])

    def finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                g, first = shingles(p.column(1), shingle)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([_fine(g[a:z]) for a, z in zip(first[:-1], first[1:])], pa.list_(pa.int64()))], ["sid", "fine"])

    def compared(pairs: pa.Table, have: pa.Table) -> pa.Table:
        of = {i: x.values.to_numpy() for i, x in zip(have["sid"].to_pylist(), have["s"])}
        on = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            u, v = of[a], of[b]
            both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) >= similarity * max(len(u), len(v)) else 0
            on.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
        return pairs.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    rows = cut(mapped(docs, ["doc_id", "text", "th"], signed, "doc_id bigint, th bigint, sid bigint, n int, fp bigint, keys array<bigint>, sketch array<bigint>"))
    one = F.min(F.struct("doc_id", "th")).alias("least")
    classes = cut(rows.groupBy("sid").agg(one, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).where("size(keys) > 0"))
    banded = classes.select("sid", "n", "sketch", F.posexplode("keys").alias("t", "key")).select("sid", "n", "sketch", F.xxhash64("t", "key").alias("k"))
    near_fp = linked(classes.select("fp").distinct(), radius)
    by_fp = classes.join(near_fp, F.col("fp") == F.col("node"), "left").select("sid", "n", "sketch", F.coalesce("component", "fp").alias("f"))
    links = cut(_pairs(_pivots(banded, "k", similarity).union(_pivots(by_fp, "f", similarity))))
    alike = not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty()

    def read(sids: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` over the texts of these, one row each."""
        wanted = cut(sids.distinct().join(classes.select("sid", "least.*"), "sid"))
        texts = docs.join(maybe_broadcast(wanted, wanted.count(), BROADCAST_KEYS), ["doc_id", "th"]).select("sid", "text")
        return cut(mapped(texts.dropDuplicates(["sid"]) if alike else texts, ["sid", "text"], fn, schema))  # of rows alike, one will do

    def near(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are similar; pairs are compared in blocks, to each of which a set goes once."""
        have = read(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), sets, "sid bigint, s array<bigint>")
        n = int((pairs.count() / BLOCK_PAIRS) ** 0.5) + 1
        at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(n))
        blocks = pairs.select((at("a") * n + at("b")).alias("block"), "a", "b")
        need = blocks.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("sid")).distinct().join(have, "sid").select("to", "sid", "s")
        return cut(blocks.groupBy("block").cogroup(need.groupBy("to")).applyInArrow(compared, "a bigint, b bigint"))

    found = near(links)
    groups = banded.select(F.struct(F.lit(0).alias("of"), F.col("k")).alias("g"), "sid", "n", "sketch").union(by_fp.select(F.struct(F.lit(1).alias("of"), F.col("f").alias("k")).alias("g"), "sid", "n", "sketch"))
    mixed = _mixed(groups, "g", components(found))
    finer = read(mixed.select("m.sid"), finely, "sid bigint, fine array<bigint>")
    rest = cut(_pairs(_rest(mixed, "g", finer, similarity)).join(links, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = found.union(near(rest))
    of = cut(components(found))
    return rows.select("doc_id", "th", "sid").join(of, F.col("sid") == F.col("node"), "left").select("doc_id", "th", F.coalesce("component", "sid").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, one row of each near-duplicate group: the one with the least doc_id, and of its texts in the group that with the least hash.

    A group is linked by pairs whose shingles have the Jaccard similarity. Rows are told apart by id and text:
    rows that share an id but not a text are documents of their own, and of rows alike in both any one stays. A null
    or empty text has no shingles and is like any other such. Rows without an id stay and link nothing. Needs
    doc_id and text; columns stay as they are, whatever their names. An empty table gives no rows.
    """
    groups = cut(similar(docs, shingle, radius, similarity))
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*")
    alike = groups.groupBy("doc_id", "th").count()
    out = cut(alike.join(kept.withColumn("kept", F.lit(True)), ["doc_id", "th"], "left").where("kept IS NULL OR count > 1"))  # all but those whose one row stays
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    key = (F.col("id") == F.col("doc_id")) & (F.col("h") == F.col("th"))
    stay = rows.join(maybe_broadcast(out.select("doc_id", "th"), out.count(), BROADCAST_KEYS), key, "left_anti").select("row")
    again = out.where("kept").select("doc_id", "th")
    if again.isEmpty():
        return stay.select("row.*")
    one = rows.join(maybe_broadcast(again, again.count(), BROADCAST_KEYS), key, "left_semi").dropDuplicates(["id", "h"]).select("row")
    return stay.union(one).select("row.*")
