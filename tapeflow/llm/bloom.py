"""A blocked Bloom filter in native expressions: one 64-bit word is a block, a key sets bits of one block only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: Words of the filter at most: 16 MB, the bound of what is broadcast. It holds 8 million keys at 16 bits a key; twice as
#: many get 8 bits each, and so on. A thinner filter lets more rows into the exact join, which alone decides.
MOST_WORDS = 1 << 21


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("mask"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def size(n_keys: int, most_words: int = MOST_WORDS) -> int:
    return max(1, min(most_words, -(-n_keys * BITS_PER_KEY // 64)))


def build(keys: DataFrame, column: str, words: int) -> DataFrame:
    """One row, one column ``bits``: an array of ``words`` longs. Nulls are no keys."""
    spark = keys.sparkSession
    key = F.col(column)
    blocks = keys.where(key.isNotNull()).groupBy(_block(key, words).alias("id")).agg(F.bit_or(_mask(key)).alias("bits"))
    every = blocks.unionByName(spark.range(0, words, 1, max(1, words // 4096)).select("id", F.lit(0).cast("bigint").alias("bits")))
    summed = every.groupBy("id").agg(F.bit_or("bits").alias("bits"))
    return summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def may_contain(bits: Column, words: int, key: Column) -> Column:
    """False: the key was not put in. A null key gives false."""
    mask = _mask(key)
    return F.coalesce(F.get(bits, _block(key, words).cast("int")).bitwiseAND(mask) == mask, F.lit(False)) & key.isNotNull()
