"""Cardinality sketches and Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pfadd(df: DataFrame, key: str, element: str, lg_k: int = 14) -> DataFrame:
    """(key, sketch): a mergeable sketch of the distinct elements of each key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.hll_sketch_agg(element, F.lit(lg_k)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("n"))


def pfmerge(sketches: DataFrame, target) -> DataFrame:
    """The union of all sketches as one row."""
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(target).alias("key"), "sketch")


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hash functions for a capacity and a share of false positives."""
    if not 0 < error < 1 or capacity <= 0:
        raise ValueError("a filter needs an error between 0 and 1 and a capacity above 0")
    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def _positions(item: Column, bits: int, hashes: int) -> Column:
    # two hashes give all others; null items have no positions
    a, b = F.xxhash64(item), F.xxhash64(item, F.lit(0x5BD1E995))
    one = lambda i: F.pmod(F.hash(a, b, i).cast("bigint") * 4294967296 % bits + F.hash(b, i), F.lit(bits).cast("bigint"))
    return F.when(item.isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(hashes)), one))


def bloom_add(items: DataFrame, key: str, item: str, capacity: int, error: float) -> DataFrame:
    """(key, bucket, bits): the filter of each key as bitmaps, built by partial aggregation."""
    bits, hashes = bloom_size(capacity, error)
    rows = items.select(F.col(key).alias("key"), F.col(item).alias("_item")).withColumn("_p", _positions(F.col("_item"), bits, hashes)).select("key", F.explode("_p").alias("p"))
    return rows.groupBy("key", F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def bloom_exists(filters: DataFrame, asked: DataFrame, key: str, item: str, capacity: int, error: float) -> DataFrame:
    """Asked (key, item) with `found`: true for all that was added, and for few others.

    A missing filter holds nothing.
    """
    bits, hashes = bloom_size(capacity, error)
    rows = asked.select(F.col(key).alias("key"), F.col(item).alias("item")).withColumn("_p", _positions(F.col("item"), bits, hashes)).select("key", "item", F.explode_outer("_p").alias("p")).withColumn("bucket", F.bitmap_bucket_number("p"))
    pos = F.bitmap_bit_position("p")
    joined = rows.join(filters, ["key", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.call_function("shiftright", byte, (pos % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return joined.groupBy("key", "item").agg(F.min(on).alias("found"))
