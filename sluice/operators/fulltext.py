"""Full-text search: tokens, postings, boolean and phrase matching, BM25, and a stored index that searches read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B, PHRASE_BONUS = 1.2, 0.75, 0.25


def tokens(text: str | Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, term), one row a token."""
    return docs.select(key, F.posexplode(tokens(text)).alias("position", "term"))


def term_statistics(post: DataFrame) -> DataFrame:
    """(term, df, tf) over all documents."""
    key = post.columns[0]
    return post.groupBy("term", key).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, ids): the inverted index, ids of a term sorted."""
    return postings(docs, key, text).groupBy("term").agg(F.sort_array(F.collect_set(key)).alias("ids"))


def parse(query: str) -> tuple[list[str], list[list[str]]]:
    """Distinct terms, those of phrases included, and phrases of two words or more."""
    import re

    word = re.compile(r"[^\W_]+")
    phrases = [p for p in (word.findall(x.lower()) for x in re.findall(r'"([^"]*)"', query)) if p]
    return list(dict.fromkeys(word.findall(query.lower()))), [p for p in phrases if len(p) > 1]


def _has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words follow each other somewhere; tokens hold no space, so joined texts can be searched."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def matching(docs: DataFrame, key: str, text: str, query: str, mode: str = "all", exclude: str = "") -> DataFrame:
    """(key, words) of the documents that have all (or any) terms and phrases, and none of the excluded ones; no index is needed, a document is judged by itself."""
    terms, phrases = parse(query)
    no_terms, no_phrases = parse(exclude)
    if not terms:
        return docs.select(key, tokens(text).alias("words")).limit(0)
    loose = [t for t in terms if not any(t in p for p in phrases)]
    w = F.col("words")
    tests = [F.array_contains(w, t) for t in loose] + [_has_phrase(w, p) for p in phrases]
    keep = tests[0]
    for t in tests[1:]:
        keep = keep & t if mode == "all" else keep | t
    alone = [t for t in no_terms if not any(t in p for p in no_phrases)]
    for t in [F.array_contains(w, t) for t in alone] + [_has_phrase(w, p) for p in no_phrases]:
        keep = keep & ~t
    return docs.select(key, tokens(text).alias("words")).where(keep)


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, position, term): each token with the number of its document's; texts are read once."""
    return docs.select(key, tokens(text).alias("words")).select(key, F.size("words").alias("size"), F.posexplode("words").alias("position", "term"))


def _ranked(found: DataFrame, corpus: DataFrame, key: str, query: str, k: int | None, mode: str, exclude: str) -> DataFrame:
    """Best documents; found: (key, size, term, places) of the terms asked for, corpus: one row (n, total)."""
    terms, phrases = parse(query)
    no_terms, no_phrases = parse(exclude)
    if not terms:
        return found.select(key, F.lit(0.0).alias("score")).limit(0)
    every = list(dict.fromkeys(terms + no_terms))
    at = {t: F.col(f"p{i}") for i, t in enumerate(every)}
    df = {t: F.col(f"df{i}") for i, t in enumerate(every)}
    found = found.where(F.col("term").isin(every))
    rows = found.groupBy(key).agg(F.first("size").alias("size"), *[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(every)])
    counts = found.agg(*[F.count(F.when(F.col("term") == t, 1)).alias(f"df{i}") for i, t in enumerate(every)])
    has = lambda t: at[t].isNotNull()

    def follows(p: list[str]) -> Column:
        """Whether the words stand one after the other somewhere."""
        starts = at[p[0]]
        for j, t in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, F.transform(at[t], lambda x: x - j))  # noqa: B023
        return F.coalesce(F.size(starts) > 0, F.lit(False))

    tests = [has(t) for t in terms if not any(t in p for p in phrases)] + [follows(p) for p in phrases]
    keep = tests[0]
    for t in tests[1:]:
        keep = keep & t if mode == "all" else keep | t
    for t in [has(t) for t in no_terms if not any(t in p for p in no_phrases)] + [follows(p) for p in no_phrases]:
        keep = keep & ~t
    mean = F.greatest(F.lit(1.0), F.col("total") / F.col("n"))
    out = F.lit(0.0)
    for t in terms:
        tf = F.coalesce(F.size(at[t]), F.lit(0)).cast("double")
        out = out + F.log1p((F.col("n") - df[t] + 0.5) / (df[t] + 0.5)) * F.when(has(t), tf).otherwise(0.0) * (K1 + 1) / (F.when(has(t), tf).otherwise(0.0) + K1 * (1 - B + B * F.col("size") / mean))
    for p in phrases:
        out = out + F.when(follows(p), F.lit(PHRASE_BONUS * len(p))).otherwise(0.0)
    hits = rows.where(keep).crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(counts))  # a row each
    ranked = hits.select(key, F.round(out, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key)
    return ranked.limit(k) if k else ranked


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int | None = None, mode: str = "any", exclude: str = "") -> DataFrame:
    """(key, score) by BM25 (k1 1.2, b 0.75), plus a quarter for each word of a phrase that is there; best first, then by key.

    Document counts and lengths are of the whole table; documents without words count in neither. Without an
    index: texts are read for the terms, for their counts and for the lengths.
    """
    placed = _placed(docs, key, text)
    terms = [*parse(query)[0], *parse(exclude)[0]]
    found = placed.where(F.col("term").isin(terms)).groupBy(key, "term").agg(F.first("size").alias("size"), F.collect_list("position").alias("places"))
    corpus = docs.select(F.size(tokens(text)).alias("size")).where("size > 0").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    return _ranked(found, corpus, key, query, k, mode, exclude)


@dataclass(frozen=True)
class TextIndex:
    """A stored inverted index: postings with places in folders by a hash of the term, and the corpus's counts.

    A search reads the folders of its terms, and of these only the row groups that may hold them.
    """

    spark: SparkSession
    at: str
    key: str
    buckets: int

    @staticmethod
    def build(docs: DataFrame, key: str, text: str, at: str, buckets: int = 64, splits: int = 1) -> TextIndex:
        """Reads the texts once; a term's postings are in ``splits`` files, by a hash of the key, so a common one is many."""
        post = _placed(docs, key, text).groupBy(key, "term").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("position")).alias("places"))
        post = post.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
        post.repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(splits))).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{at}/postings")
        out = TextIndex(docs.sparkSession, at, key, buckets)
        sizes = out.postings().groupBy(key).agg(F.first("size").alias("size"))
        sizes.agg(F.count("*").alias("n"), F.sum("size").alias("total")).write.parquet(f"{at}/corpus")
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(key, term, size, places), of all terms or these."""
        p = self.spark.read.parquet(f"{self.at}/postings")
        if terms is not None:
            homes = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.hash("t"), F.lit(self.buckets))).collect()}) if terms else []
            p = p.where(F.col("bucket").isin(homes) & F.col("term").isin(terms))
        return p.drop("bucket")

    def search(self, query: str, k: int | None = None, mode: str = "any", exclude: str = "") -> DataFrame:
        """(key, score) as ``bm25`` ranks them."""
        found = self.postings([*parse(query)[0], *parse(exclude)[0]])
        return _ranked(found, self.spark.read.parquet(f"{self.at}/corpus"), self.key, query, k, mode, exclude)
