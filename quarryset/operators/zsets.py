"""Sorted sets as rows (key, member, score), in the order of score and member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.functions.text import glob, in_slice, within_lex, within_score
from quarryset.operators.ordering import accumulated


def _order():
    return W.partitionBy("key").orderBy("score", "member")


def _back():
    return W.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))


def zadd(ops: DataFrame, existing: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """Members after ops (key, member, score, seq): the last score wins; null scores are refused.

    `only`: `nx` keeps what exists and adds the rest, with the first score of each; `xx` changes
    only what exists.
    """
    ops = ops.filter("key is not null and member is not null and score is not null and not isnan(score)")
    pick = F.min_by if only == "nx" else F.max_by
    new = ops.groupBy("key", "member").agg(pick("score", "seq").alias("score"))
    if existing is None:
        return new.limit(0) if only == "xx" else new
    if only == "xx":
        new = new.join(existing.select("key", "member"), ["key", "member"], "left_semi")
    if only == "nx":
        return existing.unionByName(new.join(existing, ["key", "member"], "left_anti"))
    return existing.join(new, ["key", "member"], "left_anti").unionByName(new)


def zadd_changed(ops: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, added, changed): what a ZADD reports, without and with CH."""
    new = zadd(ops).join(existing.withColumnRenamed("score", "_old"), ["key", "member"], "left")
    fresh = F.col("_old").isNull()
    return new.groupBy("key").agg(F.count_if(fresh).alias("added"), F.count_if(fresh | (F.col("_old") != F.col("score"))).alias("changed"))


def zincrby(ops: DataFrame) -> DataFrame:
    """Scores after adding up all increments (key, member, score)."""
    return ops.groupBy("key", "member").agg(F.sum("score").alias("score"))


def ranked(z: DataFrame) -> DataFrame:
    """Adds the 0-based `rank` and the size `card` of each key; a hot key is no single task's work."""
    return accumulated(z, "key", ["score", "member"], None, "rank", "card").withColumn("rank", F.col("rank") - 1)


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """(key, member, score, rank) of a slice by rank. Slices that start at the front need only the
    first rows of each key, which Spark cuts before the shuffle."""
    if start >= 0 and stop >= 0:
        pos = (F.row_number().over(_back() if reverse else _order()) - 1).cast("bigint")
        return z.withColumn("rank", pos).filter((F.col("rank") <= stop) & (F.col("rank") >= start))
    return _turned(ranked(z), reverse).filter(in_slice(F.col("rank"), start, stop, F.col("card"))).drop("card")


def zrank(z: DataFrame, reverse: bool = False) -> DataFrame:
    return _turned(ranked(z), reverse).drop("card")


def _turned(r: DataFrame, reverse: bool) -> DataFrame:
    return r.withColumn("rank", F.col("card") - 1 - F.col("rank")) if reverse else r


def zrangebyscore(z: DataFrame, low, high, offset: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """(key, member, score) within score bounds, with paging inside each key."""
    hit = z.filter(within_score(F.col("score"), low, high))
    return _page(hit, offset, count, reverse)


def zrangebylex(z: DataFrame, low: str, high: str, offset: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Members within bounds in byte order; meant for keys whose scores are all equal."""
    return _page(z.filter(within_lex(F.col("member"), low, high)), offset, count, reverse)


def _page(hit: DataFrame, offset: int, count: int | None, reverse: bool) -> DataFrame:
    if not offset and count is None:
        return hit
    n = F.row_number().over(_back() if reverse else _order())
    out = hit.withColumn("_n", n).filter(F.col("_n") > offset)
    return (out if count is None else out.filter(F.col("_n") <= offset + count)).drop("_n")


def zscan(z: DataFrame, key, after: tuple[float, str] | None, count: int, pattern: str | None = None) -> DataFrame:
    """One page of a key in the order of (score, member), after the last pair seen; the pattern
    applies before the page is cut."""
    page = z.filter(F.col("key") == F.lit(key))
    if pattern is not None:
        page = page.filter(glob(F.col("member").cast("string"), pattern))
    if after is not None:
        s, m = after
        page = page.filter((F.col("score") > s) | ((F.col("score") == s) & (F.col("member") > m)))
    return page.orderBy("score", "member").limit(count)


def zcount(z: DataFrame, low, high) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(within_score(F.col("score"), low, high)).alias("n"))


def zlexcount(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(within_lex(F.col("member"), low, high)).alias("n"))


def zscore(z: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked pairs (key, member) with their score, null where there is none."""
    return asked.select("key", "member").join(z.select("key", "member", "score"), ["key", "member"], "left")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def zremrangebyscore(z: DataFrame, low, high) -> DataFrame:
    return z.filter(~within_score(F.col("score"), low, high))


def zremrangebylex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(~within_lex(F.col("member"), low, high))


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    r = ranked(z)
    return r.filter(~in_slice(F.col("rank"), start, stop, F.col("card"))).drop("rank", "card")


def zstore(inputs: list[DataFrame], weights: list[float] | None = None, aggregate: str = "sum", intersect: bool = False) -> DataFrame:
    """(member, score) of the union or intersection of (member, score) inputs.

    One union and one aggregation, whatever the number of inputs. inf + -inf counts as 0.
    """
    weights = weights or [1.0] * len(inputs)
    every = None
    for i, (z, w) in enumerate(zip(inputs, weights, strict=True)):
        part = z.select("member", (F.col("score") * F.lit(float(w))).alias("score"), F.lit(i).alias("_i"))
        every = part if every is None else every.unionByName(part)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    out = every.groupBy("member").agg(fold("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    if intersect:
        out = out.filter(F.col("_n") == len(inputs))
    return out.select("member", F.when(F.isnan("score"), 0.0).otherwise(F.col("score")).alias("score"))
