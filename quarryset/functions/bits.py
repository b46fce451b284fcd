"""Bit operations on BINARY columns; bit 0 is the highest bit of the first byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_at(value: Column, index: Column) -> Column:
    """Unsigned byte at a 0-based index; 0 beyond the end."""
    hexed = F.hex(F.substring(value, index + 1, F.lit(1)))
    return F.when(index < F.octet_length(value), F.conv(hexed, 16, 10).cast("int")).otherwise(0)


def to_bytes(value: Column) -> Column:
    """Array of the unsigned bytes of a value."""
    n = F.octet_length(value)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte_at(value, i))).otherwise(F.array().cast("array<int>"))


def from_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def getbit(value: Column, offset: Column | int) -> Column:
    o = F.lit(offset) if isinstance(offset, int) else offset
    return F.call_function("shiftright", byte_at(value, F.floor(o / 8).cast("int")), (F.lit(7) - o % 8).cast("int")).bitwiseAND(1)


def setbit(value: Column, offset: int, bit: int) -> Column:
    """A value with one bit set or cleared; it grows by zero bytes as far as needed."""
    from quarryset.functions.text import overwrite

    at, mask = offset // 8, 1 << (7 - offset % 8)
    old = byte_at(F.coalesce(value, F.lit(b"")), F.lit(at))
    new = old.bitwiseOR(mask) if bit else old.bitwiseAND(255 - mask)
    return overwrite(value, at, F.unhex(F.lpad(F.hex(new), 2, "0")))


def bitcount(value: Column, start: int = 0, stop: int = -1) -> Column:
    """Set bits in an inclusive range of bytes, negatives from the end. Null counts as empty."""
    from quarryset.functions.text import byte_range

    part = byte_range(F.coalesce(value.cast("binary"), F.lit(b"")), start, stop)
    return F.aggregate(to_bytes(part), F.lit(0), lambda a, b: a + F.bit_count(b).cast("int")).cast("bigint")


def bitpos(value: Column, bit: int, start: int = 0, stop: int | None = None) -> Column:
    """Place of the first bit with this value in a range of bytes (inclusive, negatives from the
    end), -1 if there is none. Without a `stop` a zero lies after the end of a value of ones only."""
    from quarryset.functions.text import byte_range

    whole = F.coalesce(value.cast("binary"), F.lit(b""))
    size = F.octet_length(whole)
    first = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    part = whole if start == 0 and stop is None else byte_range(whole, start, -1 if stop is None else stop)
    n = F.octet_length(part)
    found = F.when(n > 0, F.array_position(F.transform(F.sequence(F.lit(0), n * 8 - 1), lambda i: getbit(part, i)), bit)).otherwise(F.lit(0))
    beyond = F.lit(-1) if bit or stop is not None else F.when(n > 0, (first + n) * 8).when(size == 0, F.lit(0)).otherwise(F.lit(-1))
    return F.when(found > 0, found - 1 + first * 8).otherwise(beyond).cast("bigint")


def bitnot(value: Column) -> Column:
    return from_bytes(F.transform(to_bytes(value), lambda b: b.bitwiseXOR(255)))


def bitop(df: DataFrame, group: str, value: str, op: str) -> DataFrame:
    """(group, value): AND, OR or XOR of the values of a group, bytewise, padded with zero bytes.

    Bytes are folded by aggregation, so a group of any size takes no more than its longest value.
    A null value counts as empty; the result of empty values only is empty.
    """
    v = F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.octet_length(v)).alias("_len"))
    rows = df.select(group, F.posexplode(to_bytes(v)).alias("_i", "_b"))
    fold = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[op.lower()]
    folded = rows.groupBy(group, "_i").agg(fold("_b").alias("_b"), F.count(F.lit(1)).alias("_m")).join(sizes, group)
    if op.lower() == "and":  # a value that is too short counts as zero there
        folded = folded.withColumn("_b", F.when(F.col("_m") == F.col("_n"), F.col("_b")).otherwise(0))
    joined = folded.groupBy(group).agg(from_bytes(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda x: x["_b"])).alias(value))
    return sizes.select(group).join(joined, group, "left").select(group, F.coalesce(value, F.lit(b"").cast("binary")).alias(value))
