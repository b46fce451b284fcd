"""Strings as rows (key, value) and as logs of writes (key, value, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryset.operators.ordering import accumulated


def set_last(writes: DataFrame) -> DataFrame:
    """(key, value, expire_at_ms) after all writes (key, value, seq, ts_ms, ttl_ms): the last one
    wins, and clears an earlier expiry if it has none."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "ts_ms", "ttl_ms"), "seq").alias("w"))
    return last.select("key", "w.value", (F.col("w.ts_ms") + F.col("w.ttl_ms")).alias("expire_at_ms"))


def setnx(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Absent keys get their first write."""
    first = writes.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
    return existing.unionByName(first.join(existing, "key", "left_anti"))


def setxx(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Only keys that exist are written."""
    last = writes.groupBy("key").agg(F.max_by("value", "seq").alias("value")).join(existing, "key", "left_semi")
    return existing.join(last, "key", "left_anti").unionByName(last)


def mset(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All of the new keys (key, value) replace what is there."""
    return existing.join(new.select("key"), "key", "left_anti").unionByName(new.select(*existing.columns))


def msetnx(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All of the new keys or, if any of them exists, none."""
    clash = new.join(existing, "key", "left_semi").agg(F.count(F.lit(1)).alias("_c"))
    return existing.unionByName(new.crossJoin(F.broadcast(clash)).filter("_c = 0").select(*existing.columns))


def mget(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked keys (key, i) with their value, null where there is none."""
    return asked.join(existing.select("key", "value"), "key", "left").select("i", "key", "value")


def getset(writes: DataFrame) -> DataFrame:
    """(key, seq, old): what each write replaced."""
    p = accumulated(writes.select("key", "seq", "value"), "key", ["seq"], None, "_i")
    return p.join(p.select("key", (F.col("_i") + 1).alias("_i"), F.col("value").alias("old")), ["key", "_i"], "left").select("key", "seq", "old")


def append(writes: DataFrame) -> DataFrame:
    """(key, value): all written parts of a key, in order. Null parts are left out."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return writes.filter("value is not null").groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"))


def running(deltas: DataFrame) -> DataFrame:
    """(key, seq, value): a counter after each increment."""
    return accumulated(deltas.select("key", "seq", "delta"), "key", ["seq"], "delta", "value").drop("delta")


def incrby(existing: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after all increments; overflow and text that is no number give null."""
    add = deltas.groupBy("key").agg(F.sum("delta").alias("_d"))
    return existing.join(add, "key", "full").select("key", F.try_add(F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("value").try_cast("bigint")), F.coalesce("_d", F.lit(0).cast("bigint"))).alias("value"))


def incrbyfloat(existing: DataFrame, deltas: DataFrame) -> DataFrame:
    """As `incrby`, in double precision; text that is no number, and results that are not finite, give null."""
    add = deltas.groupBy("key").agg(F.sum("delta").alias("_d"))
    total = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.col("value").try_cast("double")) + F.coalesce("_d", F.lit(0.0))
    return existing.join(add, "key", "full").select("key", F.when(F.abs(total) < float("inf"), total).alias("value"))


def get(existing: DataFrame, key) -> DataFrame:
    """(key, value) of one key, no row if it is absent."""
    return existing.filter(F.col("key") == F.lit(key)).select("key", "value")


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
