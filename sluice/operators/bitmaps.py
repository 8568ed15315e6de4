"""Sets of non-negative ids as bitmaps: a row for each bucket of 32,768 ids, its bits in a binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a bucket, as Spark's bitmap functions have it.
WIDE = 32_768


def build(df: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) of the ids of a column; ids may repeat."""
    return df.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(F.col(key) + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key) + 1)).alias("bits"))


def _joined(a: DataFrame, b: DataFrame, how: str, op) -> DataFrame:
    """Buckets of both, 64 bits at a time as longs."""
    hexes = lambda c: F.hex(c)
    word = lambda c, i: F.conv(F.substring(c, i * 8 + 1, 8), 16, 10).cast("bigint")
    both = a.select("bucket", hexes("bits").alias("a")).join(b.select("bucket", hexes("bits").alias("b")), "bucket", how)
    words = F.transform(F.sequence(F.lit(0), F.lit(WIDE // 32 - 1)), lambda i: F.lpad(F.hex(op(F.coalesce(word(F.col("a"), i), F.lit(0)), F.coalesce(word(F.col("b"), i), F.lit(0)))), 8, "0"))
    return both.select("bucket", F.unhex(F.array_join(words, "")).alias("bits"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, "inner", lambda x, y: x.bitwiseAND(y))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, "left", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def count(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def ids(bits: DataFrame, name: str = "id") -> DataFrame:
    """The ids, one row each."""
    byte: Column = F.conv(F.substring(F.hex("bits"), F.col("i") * 2 + 1, 2), 16, 10).cast("int")
    rows = bits.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(WIDE // 8 - 1))).alias("i")).select("bucket", "i", byte.alias("byte")).where("byte != 0")
    bit = rows.select("bucket", "i", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).where("(byte & (1 << j)) != 0")
    return bit.select(((F.col("bucket") - 1) * WIDE + F.col("i") * 8 + F.col("j")).cast("bigint").alias(name))
