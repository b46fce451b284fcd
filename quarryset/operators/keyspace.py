"""The table of keys (key, type, expire_at_ms, db). The clock is an argument, never hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryset.functions.text import glob
from quarryset.operators.ordering import running_total


def alive(now_ms: int | Column) -> Column:
    return F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms)


def visible(keys: DataFrame, now_ms: int) -> DataFrame:
    return keys.filter(alive(now_ms))


def keys_like(keys: DataFrame, pattern: str, now_ms: int) -> DataFrame:
    return visible(keys, now_ms).filter(glob(F.col("key"), pattern)).select("key")


def scan(keys: DataFrame, after: str | None, count: int, now_ms: int, pattern: str | None = None) -> DataFrame:
    """One page: keys after the last one seen, in order. A page costs a top-k, whatever its place."""
    page = visible(keys, now_ms)
    if after is not None:
        page = page.filter(F.col("key") > after)
    if pattern is not None:
        page = page.filter(glob(F.col("key"), pattern))
    return page.select("key").orderBy("key").limit(count)


def exists(keys: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Asked keys with `found` and `type` (`none` if absent)."""
    seen = visible(keys, now_ms).select("key", F.col("type").alias("_t"))
    return asked.select("key").distinct().join(seen, "key", "left").select("key", F.col("_t").isNotNull().alias("found"), F.coalesce("_t", F.lit("none")).alias("type"))


def dbsize(keys: DataFrame, now_ms: int) -> DataFrame:
    return visible(keys, now_ms).agg(F.count(F.lit(1)).alias("n"))


def randomkey(keys: DataFrame, now_ms: int, seed: int) -> DataFrame:
    return visible(keys, now_ms).select("key").orderBy(F.md5(F.concat(F.col("key"), F.lit(f"/{seed}"))), "key").limit(1)


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("key").distinct(), "key", "left_anti")


def deleted(table: DataFrame, gone: DataFrame) -> DataFrame:
    """(n): how many of the keys were there."""
    return table.select("key").distinct().join(gone.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def dump(table: DataFrame, key) -> DataFrame:
    """All rows of a key, to be stored or moved to another keyspace with `restore`."""
    return table.filter(F.col("key") == F.lit(key))


def restore(table: DataFrame, rows: DataFrame, key, replace: bool = False) -> DataFrame:
    """Dumped rows under a (new) key. A key that exists stays as it is unless `replace`."""
    new = rows.withColumn("key", F.lit(key)).select(*table.columns)
    if replace:
        return table.filter(~F.col("key").eqNullSafe(F.lit(key))).unionByName(new)
    there = table.agg(F.count_if(F.col("key") == F.lit(key)).alias("_c"))
    return table.unionByName(new.crossJoin(F.broadcast(there)).filter("_c = 0").drop("_c"))


def rename(table: DataFrame, old: str, new: str, only_new: bool = False) -> DataFrame:
    """Re-keys rows, expiry included; what the new key held is replaced. With `only_new` an
    existing target leaves all as it is. A missing old key changes nothing."""
    n = table.agg(F.count_if(F.col("key") == old).alias("_old"), F.count_if(F.col("key") == new).alias("_new"))
    go = F.col("_old") > 0 if not only_new else (F.col("_old") > 0) & (F.col("_new") == 0)
    marked = table.crossJoin(F.broadcast(n)).withColumn("_go", go & F.lit(old != new))
    kept = marked.filter(~(F.col("_go") & (F.col("key") == new)))
    return kept.withColumn("key", F.when(F.col("_go") & (F.col("key") == old), F.lit(new)).otherwise(F.col("key"))).select(*table.columns)


def move(keys: DataFrame, key: str, source: int, target: int) -> DataFrame:
    """Moves a key between databases unless the target has it."""
    n = keys.agg(F.count_if((F.col("key") == key) & (F.col("db") == target)).alias("_t"))
    hit = (F.col("key") == key) & (F.col("db") == source) & (F.col("_t") == 0)
    return keys.crossJoin(F.broadcast(n)).withColumn("db", F.when(hit, F.lit(target)).otherwise(F.col("db"))).select(*keys.columns)


def expire(keys: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Sets the expiry of keys from (key, at_ms); the last deadline of `seq` wins."""
    last = deadlines.groupBy("key").agg(F.max_by("at_ms", "seq").alias("_at"))
    return keys.join(last, "key", "left").withColumn("expire_at_ms", F.coalesce("_at", "expire_at_ms")).drop("_at")


def persist(keys: DataFrame, asked: DataFrame) -> DataFrame:
    hit = asked.select("key").distinct().withColumn("_p", F.lit(True))
    return keys.join(hit, "key", "left").withColumn("expire_at_ms", F.when(F.col("_p"), F.lit(None).cast("bigint")).otherwise(F.col("expire_at_ms"))).drop("_p")


def ttl(keys: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Milliseconds left; -1 without expiry, -2 if the key is absent or expired."""
    joined = asked.select("key").distinct().join(keys.select("key", "expire_at_ms", F.lit(True).alias("_k")), "key", "left")
    left = F.when(F.col("_k").isNull() | (F.col("expire_at_ms") <= now_ms), F.lit(-2)).when(F.col("expire_at_ms").isNull(), F.lit(-1)).otherwise(F.col("expire_at_ms") - now_ms)
    return joined.select("key", left.cast("bigint").alias("ttl_ms"))


def info(keys: DataFrame, now_ms: int) -> DataFrame:
    """Keys, keys with expiry and their mean time left, for each database."""
    return visible(keys, now_ms).groupBy("db").agg(F.count(F.lit(1)).alias("keys"), F.count("expire_at_ms").alias("expires"), F.coalesce(F.floor(F.avg(F.col("expire_at_ms") - now_ms)), F.lit(0)).cast("bigint").alias("avg_ttl"))


def flush(table: DataFrame, db: int | None = None) -> DataFrame:
    return table.limit(0) if db is None else table.filter(F.col("db") != db)


def evict(keys: DataFrame, limit: int, policy: str, now_ms: int, seed: int = 0) -> DataFrame:
    """Keys to drop so that the sizes of the rest stay within a limit.

    Policies: `allkeys-lru`, `volatile-lru`, `volatile-ttl`, `allkeys-random`, `volatile-random`;
    volatile ones only drop keys that have an expiry. Needs `size` and `last_ms`.
    """
    order = {"lru": F.col("last_ms"), "ttl": F.col("expire_at_ms"), "random": F.md5(F.concat(F.col("key"), F.lit(f"/{seed}")))}[policy.split("-")[1]]
    can = F.lit(True) if policy.startswith("allkeys") else F.col("expire_at_ms").isNotNull()
    live = visible(keys, now_ms)
    total = live.agg((F.sum("size") - limit).alias("_over"))
    ordered = running_total(live.filter(can).withColumn("_by", order), ["_by", "key"], "size", "_before")
    return ordered.crossJoin(F.broadcast(total)).filter("_before < _over").select("key")
