"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Tokens are words. Equal blocks of words are seats, sources are parties and their targets are votes:
the highest quotients target/1, target/3, target/5... get the blocks. Each source's integer quota is
dealt the same way over its shards (parties of about ``shard_words`` words), so no task ever holds a
whole source. In a shard, documents lie end to end in seeded order on a ring, and the shard's blocks
are laid round that ring from its start: a document is taken once for each time a block covers a word.

The highest quotients are found without a loop over seats: a divisor that gives away at most all seats
bounds each party's quota from below, one that gives away at least all bounds it from above, and the
two bounds differ by a number of seats that sums to about the number of parties. Only these are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, maybe_broadcast

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each party of its group, by highest quotients votes/(2k-1).

    ``seats`` is constant within a group; ties go to the party that sorts first. Parties without
    votes get none.
    """
    w = Window.partitionBy(*group)
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    p = parties.withColumns({"_v": F.sum(v).over(w), "_p": F.count("*").over(w).cast("double")})
    share = v / F.when(F.col("_v") > 0, F.col("_v"))
    p = p.withColumns({
        "_lo": F.coalesce(F.greatest(F.lit(0), F.floor(share * (n - F.col("_p") / 2 - 1) + 0.5) - 1), F.lit(0)).cast("bigint"),
        "_hi": F.coalesce(F.floor(share * (n + F.col("_p") / 2 + 1) + 0.5) + 1, F.lit(0)).cast("bigint"),
    }).withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    open_ = p.where(v > 0).select(*group, party, v.alias("_v1"), "_left", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
    best = Window.partitionBy(*group).orderBy((F.col("_v1") / (2 * F.col("_k") - 1)).desc(), party)
    won = open_.withColumn("_r", F.row_number().over(best)).where("_r <= _left").groupBy(*group, party).agg(F.count("*").alias("_won"))
    return (
        p.join(won, [*group, party], "left")
        .withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0)))
        .drop("_v", "_p", "_lo", "_hi", "_left", "_won")
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``total`` and ``target``: sources (one row each) share ``share`` x all words by weight, none above ``most`` x its own.

    Sources in order of most words per weight: those before the first whose fair part of what is
    left lies under its limit get their limits, the rest share what these leave.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("_w", F.element_at(ws, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"total": F.sum("source_size").over(everything), "_cap": most * F.col("source_size")})
    order = everything.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_rest": share * F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_ws": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_i": F.row_number().over(order),
    })
    free = F.col("_cap") > F.col("_rest") * F.col("_w") / F.col("_ws")
    s = s.withColumn("_first", F.min(F.when(free, F.struct("_i", "_rest", "_ws"))).over(everything))
    return s.withColumn("target", F.when(F.col("_i") >= F.col("_first._i"), F.col("_first._rest") * F.col("_w") / F.col("_first._ws")).otherwise(F.col("_cap"))).drop(
        "_w", "_cap", "_rest", "_ws", "_i", "_first"
    )


def _dealt(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1",
           max_block: int = 1024, blocks: int = 1 << 17, shard_words: int = 1 << 18, shard_rows: int = 1 << 16, shards: int = 4096) -> DataFrame:
    """The columns of ``mix`` and ``_key``, which rows alike in id and text share."""
    slim = cut(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n")).alias("_s"), row_key(seed).alias("_key"),
    ))
    sources = cut(targets(slim.groupBy("_s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), weights, share, most))
    block = F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(share * F.col("total") / blocks))).cast("bigint")
    sources = sources.withColumns({"_b": block, "_shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / shard_rows)).cast("bigint"), "_all": F.lit(0)})
    sources = sources.withColumn("_seats", F.floor(share * F.col("total") / F.col("_b") + 0.5).cast("bigint"))
    sources = sainte_lague(sources, ["_all"], "_s", "target", "_seats").withColumn("_quota", F.least("quota", F.floor(most * F.col("source_size") / F.col("_b")).cast("bigint")))
    sources = cut(sources.select("_s", "source_size", "target", "_b", "_shards", "_quota"))
    small = maybe_broadcast(sources, sources.count(), BROADCAST_SOURCES)

    dealt = slim.join(small, "_s").withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") % F.col("_shards"))
    parts = cut(dealt.groupBy("_s", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"), F.first("_b").alias("_b"))
                .withColumn("_g", F.expr(f"_shard div {shards}")))
    groups = parts.groupBy("_s", "_g").agg(F.sum("_words").alias("_w"), F.first("_quota").alias("_quota"))
    groups = sainte_lague(groups, ["_s"], "_g", "_w", "_quota").select("_s", "_g", F.col("quota").alias("_own"))
    parts = sainte_lague(parts.join(groups, ["_s", "_g"]), ["_s", "_g"], "_shard", "_words", "_own").select(
        "_s", "_shard", "_words", F.least(F.col("quota") * F.col("_b"), F.floor(most * F.col("_words")).cast("bigint")).alias("_take"))
    ring = Window.partitionBy("_s", "_shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.select("doc_id", "size", "source_size", "target", "_s", "_shard", "_key", F.sum("size").over(ring).alias("_end"))
    laid = laid.join(parts, ["_s", "_shard"])
    rounds, rest = F.expr("_take div greatest(_words, 1)"), F.expr("_take % greatest(_words, 1)")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    return laid.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, rounds * F.col("size") + part).otherwise(0).cast("bigint").alias("taken"), "_key")


def row_key(seed: str) -> Column:
    """A seeded order of documents, by id and text."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken.

    Needs doc_id, text and source; other columns are ignored. A null text has size 0 and is never
    taken; a null source is a source of its own, sorted last; null or repeated doc_ids are fine, as
    each row is dealt by itself and rows alike in id and text are interchangeable. A very long text is
    a document like any other. An empty table gives no rows.

    Options: ``weights`` of the sources in order, ``share`` of all words that they have together, ``most``
    times its words that a source or document may be taken, ``seed``; ``blocks`` is about how many blocks the
    mix has, of ``max_block`` words at most; a shard has about ``shard_words`` words or ``shard_rows`` rows, and
    a source's quota is dealt to groups of ``shards`` shards first, then to the shards of each.
    """
    return _dealt(docs, **options).drop("_key")


def repeated(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as the words taken of it make whole documents, rounded.

    Rows alike in id and text share their mean. Columns stay as they are, whatever their names.
    """
    taken = _dealt(docs, seed=seed, **options).groupBy("_key").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("n"))
    times = cut(taken.select(F.col("_key").alias("k"), F.floor(F.col("n") + 0.5).cast("int").alias("n")).where("n > 0"))
    rows = docs.select(F.struct("*").alias("row"), row_key(seed).alias("key"))
    return rows.join(times, F.col("key") == F.col("k")).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("turn")).select("row.*")


#: DuckDB SQL of ``mix`` with its defaults, where no source has more than one group of shards (10^9 words).
SQL = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('v' || source, 'n') AS s,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
src0 AS (SELECT s, source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM slim GROUP BY s, source),
src1 AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w,
                sum(source_size) OVER ()::BIGINT AS total, 2.0::DOUBLE * source_size AS cap FROM src0),
src2 AS (SELECT *, 1.5::DOUBLE * total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws,
                row_number() OVER o AS i FROM src1 WINDOW o AS (ORDER BY cap / w ASC, source ASC NULLS LAST)),
src3 AS (SELECT *, min(CASE WHEN cap > rest * w / ws THEN i END) OVER () AS fi FROM src2),
src4 AS (SELECT a.*, CASE WHEN a.i >= a.fi THEN b.rest * a.w / b.ws ELSE a.cap END AS target,
                greatest(1, least(1024, floor(1.5::DOUBLE * a.total / 131072)))::BIGINT AS b,
                greatest(1, ceil(a.source_size / 262144), ceil(a.n_rows / 65536))::BIGINT AS shards
         FROM src3 a LEFT JOIN src3 b ON b.i = a.fi),
src5 AS (SELECT *, floor(1.5::DOUBLE * total / b + 0.5)::BIGINT AS seats, sum(target) OVER () AS v, count(*) OVER ()::DOUBLE AS p FROM src4),
src6 AS (SELECT *, coalesce(greatest(0, floor(target / nullif(v, 0) * (seats - p / 2 - 1) + 0.5) - 1), 0)::BIGINT AS lo,
                coalesce(floor(target / nullif(v, 0) * (seats + p / 2 + 1) + 0.5) + 1, 0)::BIGINT AS hi FROM src5),
src7 AS (SELECT *, seats - sum(lo) OVER () AS remaining FROM src6),
src8 AS (SELECT s, remaining, target, unnest(range(lo + 1, hi + 1)) AS k FROM src7 WHERE target > 0),
src9 AS (SELECT s, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, s) AS r FROM src8) WHERE r <= remaining GROUP BY s),
src AS (SELECT src7.s, source_size, target, b, shards, least(lo + coalesce(won, 0), floor(2.0::DOUBLE * source_size / b)::BIGINT) AS quota
        FROM src7 LEFT JOIN src9 ON src7.s = src9.s),
dealt AS (SELECT slim.*, source_size, target, b, quota, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM slim JOIN src ON slim.s = src.s),
sh1 AS (SELECT s, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota, any_value(b) AS b FROM dealt GROUP BY s, shard),
sh2 AS (SELECT *, sum(words::DOUBLE) OVER (PARTITION BY s) AS v, count(*) OVER (PARTITION BY s)::DOUBLE AS p FROM sh1),
sh3 AS (SELECT *, coalesce(greatest(0, floor(words / nullif(v, 0) * (quota - p / 2 - 1) + 0.5) - 1), 0)::BIGINT AS lo,
               coalesce(floor(words / nullif(v, 0) * (quota + p / 2 + 1) + 0.5) + 1, 0)::BIGINT AS hi FROM sh2),
sh4 AS (SELECT *, quota - sum(lo) OVER (PARTITION BY s) AS remaining FROM sh3),
sh5 AS (SELECT s, shard, words, remaining, unnest(range(lo + 1, hi + 1)) AS k FROM sh4 WHERE words > 0),
sh6 AS (SELECT s, shard, count(*) AS won FROM
         (SELECT *, row_number() OVER (PARTITION BY s ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS r FROM sh5) WHERE r <= remaining GROUP BY s, shard),
sh AS (SELECT sh4.s, sh4.shard, words, least((lo + coalesce(won, 0)) * b, 2 * words) AS take
       FROM sh4 LEFT JOIN sh6 ON sh4.s = sh6.s AND sh4.shard = sh6.shard),
laid AS (SELECT d.doc_id, size, source_size, target, words, take,
                sum(size) OVER (PARTITION BY d.s, d.shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS e
         FROM dealt d JOIN sh ON d.s = sh.s AND d.shard = sh.shard)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN take // greatest(words, 1) * size + greatest(0, least(e, take % greatest(words, 1)) - (e - size)) ELSE 0 END)::BIGINT AS taken
FROM laid
"""
