"""Lists as rows (key, pos, value); any increasing positions will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.functions.text import from_end, in_slice
from quarryset.operators.ordering import accumulated


def _front():
    return W.partitionBy("key").orderBy("pos")


def _back():
    return W.partitionBy("key").orderBy(F.desc("pos"))


def indexed(items: DataFrame) -> DataFrame:
    """Adds `i`, the 0-based index, and `len`; a long list is no single task's work."""
    return accumulated(items, "key", ["pos"], None, "i", "len").withColumn("i", F.col("i") - 1)


def renumbered(items: DataFrame) -> DataFrame:
    return accumulated(items, "key", ["pos"], None, "_i").withColumn("pos", F.col("_i") - 1).drop("_i")


def push(items: DataFrame, new: DataFrame, left: bool, only_existing: bool = False) -> DataFrame:
    """Pushes (key, value, seq) in the order of seq; with `only_existing` lists must be there."""
    ends = items.groupBy("key").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    numbered = accumulated(new, "key", ["seq"], None, "_k").join(ends, "key", "inner" if only_existing else "left")
    pos = F.coalesce("_lo", F.lit(0)) - F.col("_k") if left else F.coalesce("_hi", F.lit(-1)) + F.col("_k")
    return items.select("key", "pos", "value").unionByName(numbered.select("key", pos.cast("bigint").alias("pos"), "value"))


def pop(items: DataFrame, left: bool, n: int = 1) -> DataFrame:
    """What is left after taking n from an end of each list."""
    gone = popped(items.select("key", "pos"), left, n)
    return items.join(gone, ["key", "pos"], "left_anti")


def popped(items: DataFrame, left: bool, n: int = 1) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(_front() if left else _back())).filter(F.col("_n") <= n).drop("_n")


def rpoplpush(items: DataFrame, source, target) -> DataFrame:
    """Moves the last element of one list to the front of another (which may be the same)."""
    tail = popped(items.filter(F.col("key") == source), left=False).select("key", "pos")
    rest = items.join(tail, ["key", "pos"], "left_anti")
    moved = items.join(tail, ["key", "pos"], "left_semi").select(F.lit(target).alias("key"), "value", F.lit(0).alias("seq"))
    return push(rest, moved, left=True)


def lindex(items: DataFrame, index: int) -> DataFrame:
    """(key, value) at an index, for the lists that have it."""
    order, n = (_front(), index + 1) if index >= 0 else (_back(), -index)
    return items.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == n).select("key", "value")


def lrange(items: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, i, value) of an inclusive slice."""
    if start >= 0 and stop >= 0:
        return items.withColumn("i", (F.row_number().over(_front()) - 1).cast("bigint")).filter((F.col("i") <= stop) & (F.col("i") >= start)).select("key", "i", "value")
    return indexed(items).filter(in_slice(F.col("i"), start, stop, F.col("len"))).select("key", "i", "value")


def ltrim(items: DataFrame, start: int, stop: int) -> DataFrame:
    return renumbered(lrange(items, start, stop).select("key", F.col("i").alias("pos"), "value"))


def llen(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def lrem(items: DataFrame, n: int, value) -> DataFrame:
    """Without n elements equal to value: from the front (n > 0), the back (n < 0), or all (0)."""
    hit = F.col("value") == F.lit(value)
    if n == 0:
        return renumbered(items.filter(~F.coalesce(hit, F.lit(False))))
    w = W.partitionBy("key").orderBy("pos" if n > 0 else F.desc("pos"))
    gone = items.filter(hit).select("key", "pos").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= abs(n))
    return renumbered(items.join(gone.select("key", "pos"), ["key", "pos"], "left_anti"))


def lset(items: DataFrame, index: int, value) -> DataFrame:
    """Replaces the element at an index; lists without it stay as they are."""
    at = indexed(items)
    return at.withColumn("value", F.when(F.col("i") == from_end(index, F.col("len")), F.lit(value)).otherwise(F.col("value"))).select("key", F.col("i").alias("pos"), "value")


def linsert(items: DataFrame, pivot, value, before: bool = True) -> DataFrame:
    """Inserts next to the first pivot of each list; lists without it stay as they are."""
    at = items.filter(F.col("value") == F.lit(pivot)).groupBy("key").agg(F.min("pos").alias("pos"))
    new = at.select("key", "pos", F.lit(0 if before else 2).alias("_o"), F.lit(value).alias("value"))
    every = items.select("key", "pos", F.lit(1).alias("_o"), "value").unionByName(new)
    return accumulated(every, "key", ["pos", "_o"], None, "_i").withColumn("pos", F.col("_i") - 1).drop("_i", "_o")
