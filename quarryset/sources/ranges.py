"""Coalescing of byte ranges: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryset.operators.ordering import accumulated


def coalesce(ranges: DataFrame, gap: int) -> DataFrame:
    """(segment, start, stop, n) from (segment, start, length): ranges of a segment that lie no
    more than `gap` apart, or overlap, become one read. Ranges of length 0 or less are left out. A segment of any size spreads over tasks."""
    r = ranges.filter("length > 0").select("segment", "start", (F.col("start") + F.col("length")).alias("stop"))
    once = r.groupBy("segment", "start", "stop").agg(F.count(F.lit(1)).alias("_c"))
    reach = accumulated(once, "segment", ["start", "stop"], "stop", "_reach", op="max", exclusive=True)
    marked = reach.withColumn("_new", F.coalesce((F.col("start") - F.col("_reach") > gap).cast("int"), F.lit(1)))
    islands = accumulated(marked, "segment", ["start", "stop"], "_new", "_i")
    return islands.groupBy("segment", "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("_c").alias("n")).drop("_i")
