"""Hashes as rows (key, field, value), values as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryset.functions.text import glob


def from_columns(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One hash for each row of a table; null values are absent fields."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    return df.select(F.col(key).alias("key"), F.expr(f"stack({len(fields)}, {pairs}) as (field, value)")).filter("value is not null")


def hset(h: DataFrame, ops: DataFrame) -> DataFrame:
    """After ops (key, field, value, seq): the last value of a field wins."""
    new = ops.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    return h.join(new, ["key", "field"], "left_anti").unionByName(new)


def hsetnx(h: DataFrame, ops: DataFrame) -> DataFrame:
    """Only absent fields are set, with their first value."""
    new = ops.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value"))
    return h.unionByName(new.join(h, ["key", "field"], "left_anti"))


def hget(h: DataFrame, field: str) -> DataFrame:
    return h.filter(F.col("field") == field).select("key", "value")


def hmget(h: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """(key, i, field, value) of the asked keys, in the order of the fields; absent ones are null."""
    want = asked.select("key").distinct().select("key", F.posexplode(F.array(*map(F.lit, fields))).alias("i", "field"))
    return want.join(h, ["key", "field"], "left").select("key", "i", "field", "value")


def hgetall(h: DataFrame) -> DataFrame:
    """(key, fields) with a map for each hash."""
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hkeys(h: DataFrame, key) -> DataFrame:
    return h.filter(F.col("key") == F.lit(key)).select("field")


def hvals(h: DataFrame, key) -> DataFrame:
    return h.filter(F.col("key") == F.lit(key)).select("value")


def hscan(h: DataFrame, key, after: str | None, count: int, pattern: str | None = None) -> DataFrame:
    """One page of a hash in the order of fields; the pattern applies before the page is cut."""
    page = h.filter(F.col("key") == F.lit(key))
    if after is not None:
        page = page.filter(F.col("field") > after)
    if pattern is not None:
        page = page.filter(glob(F.col("field"), pattern))
    return page.select("field", "value").orderBy("field").limit(count)


def hexists(h: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(h.select("key", "field", F.lit(True).alias("_f")), ["key", "field"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count_distinct("field").alias("n"))


def hstrlen(h: DataFrame, field: str) -> DataFrame:
    return hget(h, field).select("key", F.octet_length("value").cast("bigint").alias("n"))


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone.select("key", "field"), ["key", "field"], "left_anti")


def hincrby(h: DataFrame, field: str, by: int | float) -> DataFrame:
    """(key, value): what isn't a number counts as absent, and as 0; overflow gives null."""
    if isinstance(by, float):
        return hget(h, field).select("key", (F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.lit(by)).alias("value"))
    return hget(h, field).select("key", F.try_add(F.coalesce(F.col("value").try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(by).cast("bigint")).alias("value"))
