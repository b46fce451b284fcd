"""Percentiles of very large numeric columns: a full distributed sort with counts per partition.

1. Equal (group, value) pairs are counted before the sort, so that repeated values cost one row.
2. The counted rows are range-partitioned by (group, value) and sorted. A hot group spreads over
   many partitions, since the value is part of the sort key. Each partition writes its running
   count within each group.
3. Counts per (partition, group) give each partition its offset in each group, which is a small
   table. A row then knows which positions of its group it covers; rows that cover a target
   position are picked, and neighbouring order statistics are interpolated exactly.

`summary` keeps, of each group, exact order statistics at positions of a fixed scale (finer
toward the top), with exact ranks. Summaries of days or partitions merge by adding ranks; the
number of values that can lie unseen between kept ones bounds the error, which is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarryset.runtime import Scratch

PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
#: Steps of the summary's scale up to the 99th percentile, from there to the 99.9th, and above.
STEPS = (1000, 10_000, 100_000)


def sorted_counts(values: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """(group, value, first, upto, n): for each distinct value of a group how many values are
    smaller, how many are not larger, and how many there are. `values` has the group's columns
    and a bigint column `value`; nulls in any of them are the caller's to remove."""
    keys = [*group, "value"]
    counted = scratch.write(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")), "counted")
    ordered = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)

    def running(batches):
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cnt = b.column(b.schema.get_field_index("cnt")).to_numpy()
            change = np.zeros(len(cnt), bool)
            for g in group:
                c = b.column(b.schema.get_field_index(g))
                codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            head = tuple(b.column(b.schema.get_field_index(g))[0].as_py() for g in group)
            total = np.cumsum(cnt)
            starts = np.concatenate([[0], np.flatnonzero(change)])
            base = np.where(starts > 0, total[starts - 1], 0)
            cum = total - np.repeat(base, np.diff(np.append(starts, len(cnt))))
            if head == last:
                cum[: starts[1] if len(starts) > 1 else len(cum)] += carry
            last, carry = tuple(b.column(b.schema.get_field_index(g))[-1].as_py() for g in group), int(cum[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cum), pa.array(np.full(len(cum), pid))], names=[*b.schema.names, "cum", "pid"])

    table = scratch.write(ordered.mapInArrow(running, kinds + ", cum bigint, pid bigint"), "sorted")
    scratch.drop(counted)
    w = W.partitionBy(*group).orderBy("pid")
    per = table.groupBy("pid", *group).agg(F.max("cum").alias("_here"))
    offsets = per.select("pid", *group, (F.sum("_here").over(w) - F.col("_here")).alias("_off"), F.sum("_here").over(W.partitionBy(*group)).alias("n"))
    return table.join(offsets, ["pid", *group]).select(*group, "value", (F.col("_off") + F.col("cum") - F.col("cnt")).alias("first"), (F.col("_off") + F.col("cum")).alias("upto"), "n")


def percentiles(ranked: DataFrame, group: list[str], probs: dict[str, float] = PROBS) -> DataFrame:
    """Exact percentiles of each group (linear interpolation between neighbours, 3 decimals)."""
    hits = []
    for name, p in probs.items():
        h = f"(n - 1) * {p!r}D"
        hits.append(f"struct('{name}' as name, floor({h}) as at, 'lo' as side)")
        hits.append(f"struct('{name}' as name, ceil({h}) as at, 'hi' as side)")
    covers = " or ".join(f"(floor((n - 1) * {p!r}D) between first and upto - 1) or (ceil((n - 1) * {p!r}D) between first and upto - 1)" for p in probs.values())
    picked = ranked.filter(covers).select(*group, "n", "value", "first", "upto", F.explode(F.expr(f"array({', '.join(hits)})")).alias("_t")).filter("_t.at between first and upto - 1")
    lo_hi = [F.max(F.when((F.col("_t.name") == n) & (F.col("_t.side") == s), F.col("value"))).alias(f"_{n}_{s}") for n in probs for s in ("lo", "hi")]
    wide = picked.groupBy(*group, "n").agg(*lo_hi)
    out = [F.expr(f"round(cast(_{n}_lo as double) + ((n - 1) * {p!r}D - floor((n - 1) * {p!r}D)) * cast(_{n}_hi - _{n}_lo as double), 3)").alias(n) for n, p in probs.items()]
    return wide.select(*group, "n", *out)


def summary(ranked: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, first, upto, n) of the kept values: a bounded number for each group."""
    a, b, c = STEPS
    mark = lambda r: f"(case when {r} < 0.99D * n then floor({r} * {a}D / n) when {r} < 0.999D * n then 10000000 + floor({r} * {b}D / n) else 20000000 + floor({r} * {c}D / n) end)"
    return ranked.filter(f"{mark('upto')} > {mark('first')} or upto = n or first = 0")


def combine(kept: DataFrame, group: list[str], span: list[str], probs: dict[str, float] = PROBS) -> DataFrame:
    """Percentiles over longer spans from summaries alone.

    `group` names what a summary belongs to, `span` what the result belongs to. For each
    percentile the result has the value and `<name>_err`: the share of n by which the true rank
    of that value can differ from the asked rank, as proven by the kept ranks.
    """
    g = W.partitionBy(*dict.fromkeys([*group, *span])).orderBy("value")
    blocks = kept.withColumn("_prev", F.coalesce(F.lag("upto").over(g), F.lit(0))).withColumn("_low", F.lag("value").over(g)).withColumn("_w", F.col("upto") - F.col("_prev")).withColumn("_gap", F.col("first") - F.col("_prev"))
    per = blocks.groupBy(*span, "value").agg(F.sum("_w").alias("_w"))
    s = W.partitionBy(*span)
    run = per.withColumn("_cum", F.sum("_w").over(s.orderBy("value"))).withColumn("n", F.sum("_w").over(s))
    want = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p))).alias("h")) for n, p in probs.items()])
    answers = run.withColumn("_t", F.explode(want)).filter("_cum >= _t.h and _cum - _w < _t.h").select(*span, "n", F.col("_t.name").alias("_name"), F.col("_t.h").alias("_h"), F.col("value").alias("_v"), "_cum")
    gaps = blocks.filter("_gap > 0").select(*span, "_low", F.col("value").alias("_next"), "_gap")
    proof = answers.join(gaps, span, "left").groupBy(*span, "n", "_name", "_h", "_v", "_cum").agg(F.coalesce(F.sum(F.when(F.expr("(_low is null or _low <= _v) and _v <= _next"), F.col("_gap"))), F.lit(0)).alias("_gap"))
    cols = []
    for n in probs:
        mine = F.col("_name") == n
        cols += [F.max(F.when(mine, F.col("_v"))).alias(n), F.round(F.max(F.when(mine, F.col("_gap") / F.col("n"))), 6).alias(f"{n}_err")]
    return proof.groupBy(*span, "n").agg(*cols)


def _digest(df: DataFrame, seed: int) -> Column:
    """64-bit hash of all columns of a row. Hashing skips nulls and runs over the ends of arrays, so
    where nulls stand, and how long arrays are, is hashed beside the values."""
    values, shape = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        shape.append(F.when(c.isNull(), "-").otherwise("+"))
        if isinstance(f.dataType, ArrayType):
            shape.append(F.size(c).cast("string"))
            c = F.array_join(c.cast("array<string>"), "\x1f", "\x00")
        values.append(c)
    return F.xxhash64(F.lit(seed), *values, F.concat(*shape))


def valid(slowlog: DataFrame) -> DataFrame:
    """(verb, day, value): rows repeated verbatim once, without null or negative durations and
    null or empty commands (or verbs); late rows belong to the day of `ts`.

    Repeated rows are told by 128 bits of all columns, so that only these, and not whole commands,
    are shuffled."""
    clean = slowlog.filter("duration >= 0 and size(command) > 0 and command[0] <> '' and ts is not null")
    one = clean.select(F.upper(F.col("command")[0]).alias("verb"), F.to_date("ts").alias("day"), F.col("duration").alias("value"), _digest(clean, 1).alias("_a"), _digest(clean, 2).alias("_b"))
    return one.distinct().select("verb", "day", "value")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    group = ["verb", "day"]
    return percentiles(sorted_counts(valid(spark.read.parquet(f"{sf}/slowlog.parquet")), group, Scratch(spark, "p3")), group)


def p3_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks, and the whole time, from the days' summaries."""
    group, scratch = ["verb", "day"], Scratch(spark, "p3")
    days = scratch.write(summary(sorted_counts(valid(spark.read.parquet(f"{sf}/slowlog.parquet")), group, scratch), group), "days")
    weeks = days.withColumn("span", F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd"))
    return combine(weeks.unionByName(days.withColumn("span", F.lit("all"))), group, ["verb", "span"])


_one = "round(cast(max(duration) filter (where r = floor((n - 1) * {p}::DOUBLE)) as double) + ((n - 1) * {p}::DOUBLE - floor((n - 1) * {p}::DOUBLE)) * cast(max(duration) filter (where r = ceil((n - 1) * {p}::DOUBLE)) - max(duration) filter (where r = floor((n - 1) * {p}::DOUBLE)) as double), 3) as {n}"
P3_SQL = (
    "with d as (select distinct * from slowlog where duration >= 0 and len(command) > 0 and command[1] <> '' and ts is not null), "
    "r as (select upper(command[1]) as verb, cast(ts as date) as day, duration, row_number() over (partition by upper(command[1]), cast(ts as date) order by duration) - 1 as r, "
    "count(*) over (partition by upper(command[1]), cast(ts as date)) as n from d) "
    "select verb, day, n, " + ", ".join(_one.format(p=p, n=n) for n, p in PROBS.items()) + " from r group by verb, day, n"
)
