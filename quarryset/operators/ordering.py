"""Running totals over a whole table or within keys, without one task that sees all of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from quarryset.runtime import Scratch


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows that come before a row in the order (which must be
    total: no two rows equal in it). Nulls in `value` count as 0."""
    one = df.withColumn("_all", F.lit(0))
    return accumulated(one, "_all", order, value, name, exclusive=True).drop("_all")


def _starts(column: pa.Array) -> np.ndarray:
    """True where a row's key differs from the row before; nulls and NaN are keys of their own."""
    new = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column[1:], column[:-1]
        same = pc.fill_null(pc.equal(a, b), False)
        if pa.types.is_floating(column.type):
            same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
        same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return new


def accumulated(df: DataFrame, key: str, order: list[str], value: str | None, name: str, total: str | None = None, op: str = "sum", exclusive: bool = False) -> DataFrame:
    """Adds the running sum of `value` (of rows, if None) within each key, this row included unless
    `exclusive`, and with `total` the key's sum. The order must be total within a key.

    `op` may be `max`: the largest value so far, null if there is none yet. Nulls in `value` count
    as 0 (or, for `max`, not at all). Decimals are added up in double precision.

    One shuffle: rows are range-partitioned by (key, order), so that a key of any size spreads over
    tasks, and each task adds up its rows in one pass. Only the first key of a partition can have
    rows in an earlier one, so that a table of one row for each partition holds what comes before.
    """
    scratch = Scratch(df.sparkSession, "order")
    kind = df.schema[value].dataType if value else None
    real = isinstance(kind, FloatType | DoubleType | DecimalType)
    v = F.lit(1).cast("bigint") if value is None else F.col(value).cast("double" if real else "bigint")
    rows = df.withColumn("_v", v).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    number = "double" if real else "bigint"

    def run(batches):
        from pyspark import TaskContext

        part, last, carry, first, seen = TaskContext.get().partitionId(), None, None, True, 0
        kind = np.float64 if real else np.int64
        none = -np.inf if real else np.iinfo(np.int64).min
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(b.schema.get_field_index(key))
            col = b.column(b.schema.get_field_index("_v"))
            x = col.fill_null(0 if op == "sum" else none).to_numpy(zero_copy_only=False).astype(kind)
            new = _starts(keys)
            goes_on = last is not None and not _starts(pa.concat_arrays([last, keys[:1]]))[1]
            new[0] = not goes_on
            at = np.flatnonzero(new | (np.arange(n) == 0))
            if op == "sum":
                run_ = np.cumsum(x)
                base = np.where(at > 0, run_[at - 1], 0)
                run_ = run_ - np.repeat(base, np.diff(np.append(at, n)))
                if goes_on:
                    run_[: at[1] if len(at) > 1 else n] += carry
                before = run_ - x
            else:
                run_ = np.concatenate([np.maximum.accumulate(x[s:e]) for s, e in zip(at, np.append(at[1:], n), strict=True)])
                if goes_on:
                    run_[: at[1] if len(at) > 1 else n] = np.maximum(run_[: at[1] if len(at) > 1 else n], carry)
                before = np.concatenate([[none], run_[:-1]])
                before[new] = none
                if goes_on:
                    before[0] = carry
            # rows of the key that the partition begins with may continue an earlier partition
            head = np.zeros(n, bool)
            if first:
                head[: at[1] if len(at) > 1 else n] = True
                first = len(at) == 1
            last, carry = keys[-1:], run_[-1]
            out = before if exclusive else run_
            nulls = (out == none) if op == "max" else None
            names, rows_ = b.schema.names, np.arange(seen, seen + n)
            seen += n
            yield pa.RecordBatch.from_arrays(
                [*(c for c, m in zip(b.columns, names, strict=True) if m != "_v"), pa.array(out, mask=nulls), pa.array(run_), pa.array(np.full(n, part, np.int32)), pa.array(head), pa.array(rows_)],
                names=[*(m for m in names if m != "_v"), "_in", "_run", "_part", "_head", "_row"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    done = scratch.write(rows.mapInArrow(run, f"{schema}, _in {number}, _run {number}, _part int, _head boolean, _row bigint"), "running")
    # one row for the key that each partition begins with, and one for that it ends with
    fold = F.sum if op == "sum" else F.max
    begin = done.filter("_row = 0").select(F.col(key).alias("_k"), "_part", F.lit(0).alias("_o"), F.lit(None).cast(number).alias("_r"))
    end = done.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("_k"), F.col("_run").alias("_r")), "_row").alias("_e")).select("_e._k", "_part", F.lit(1).alias("_o"), "_e._r")
    so_far = fold("_r").over(W.partitionBy("_k").orderBy("_part", "_o"))
    shift = begin.unionByName(end).withColumn("_before", so_far).filter("_o = 0").select("_part", "_before")
    out = done.join(F.broadcast(shift), "_part")  # as many rows as there are partitions
    moved = F.when(F.col("_head"), F.col("_before"))
    out = out.withColumn(name, F.col("_in") + F.coalesce(moved, F.lit(0)) if op == "sum" else F.greatest("_in", moved))
    if total:
        sums = df.groupBy(F.col(key).alias("_k")).agg((F.count(F.lit(1)) if value is None else F.coalesce(F.sum(F.col(value).cast(number)), F.lit(0))).alias(total))
        out = out.join(sums, F.col(key).eqNullSafe(F.col("_k")))
    return out.select(*[c for c in df.columns if c not in (name, total)], name, *([total] if total else []))
