"""Sets as distinct rows (key, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryset.functions.text import glob
from quarryset.operators.ordering import accumulated


def sadd(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").unionByName(new.select("key", "member")).filter("member is not null").distinct()


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def sismember(s: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked pairs (key, member) with `found`."""
    return asked.join(s.select("key", "member").distinct().withColumn("_f", F.lit(True)), ["key", "member"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count_distinct("member").alias("n"))


def smembers(s: DataFrame, key) -> DataFrame:
    return s.filter(F.col("key") == key).select("member").distinct()


def sscan(s: DataFrame, key, after, count: int, pattern: str | None = None) -> DataFrame:
    """One page of a key's members in order, after the last one seen; the pattern applies before
    the page is cut."""
    page = smembers(s, key)
    if pattern is not None:
        page = page.filter(glob(F.col("member").cast("string"), pattern))
    return (page if after is None else page.filter(F.col("member") > F.lit(after))).orderBy("member").limit(count)


def smove(s: DataFrame, source, target, member) -> DataFrame:
    """Moves a member if it is there; the target holds it once."""
    hit = (F.col("key") == source) & (F.col("member") == member)
    return s.withColumn("key", F.when(hit, F.lit(target)).otherwise(F.col("key"))).distinct()


def sunion(s: DataFrame, keys: list) -> DataFrame:
    return s.filter(F.col("key").isin(keys)).select("member").distinct()


def sinter(s: DataFrame, keys: list) -> DataFrame:
    """Members that all keys hold; a missing key is an empty set. One aggregation for any number."""
    n = len(set(keys))
    return s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("_n")).filter(F.col("_n") == n).select("member")


def sdiff(s: DataFrame, keys: list) -> DataFrame:
    """Members of the first key that no other holds."""
    first, rest = keys[0], [k for k in keys[1:]]
    if first in rest:
        return s.select("member").limit(0)
    seen = s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.max(F.col("key") == first).alias("_in"), F.max(F.col("key") != first).alias("_other"))
    return seen.filter("_in and not _other").select("member")


def store(members: DataFrame, key) -> DataFrame:
    """The result of an operation as the set of a key."""
    return members.select(F.lit(key).alias("key"), "member")


def srandmember(s: DataFrame, key, n: int, seed: int) -> DataFrame:
    """n > 0: up to n distinct members. n < 0: exactly -n draws with replacement (none of an empty
    set). The order, and so the draw, depends on the member and the seed only."""
    mine = smembers(s, key)
    if n >= 0:
        return mine.orderBy(F.md5(F.concat(F.col("member").cast("string"), F.lit(f"/{seed}"))), "member").limit(n)
    numbered = accumulated(mine.withColumn("_k", F.lit(0)), "_k", ["member"], None, "_i").select("member", "_i")
    total = numbered.agg(F.max("_i").alias("_n"))  # one row
    draws = s.sparkSession.range(-n).crossJoin(F.broadcast(total)).select((F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("bigint"), F.col("_n")) + 1).alias("_i"))
    return numbered.join(draws, "_i").select("member")


def spop(s: DataFrame, key, n: int, seed: int) -> DataFrame:
    """The sets without n members of a key, drawn by seed."""
    gone = srandmember(s, key, n, seed).withColumn("key", F.lit(key))
    return srem(s, gone)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
