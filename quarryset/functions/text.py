"""Patterns, bounds and positions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str, ignore_case: bool = False) -> str:
    """Anchored regular expression of a glob: `*`, `?`, `[a-c]`, `[^ab]`, and `\\` to escape."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            while i + 1 < n and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end, body = i + 1, []
            negative = end < n and pattern[end] in "^!"
            end += negative
            while end < n and (pattern[end] != "]" or not body):
                if pattern[end] == "\\" and end + 1 < n:
                    end += 1
                    body.append(re.escape(pattern[end]))
                elif pattern[end] == "-" and body and end + 1 < n and pattern[end + 1] != "]":
                    body.append("-")
                else:
                    body.append(re.escape(pattern[end]))
                end += 1
            out.append(f"[{'^' if negative else ''}{''.join(body)}]" if body else re.escape(c))
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?{'i' if ignore_case else ''}s)^{''.join(out)}$"


def glob(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a text matches a glob. A pattern without wildcards, or with only a final `*`, becomes
    an equality or a prefix, which reach the Parquet scan. Null gives null."""
    plain = re.fullmatch(r"[^*?\[\\]*", pattern)
    if plain and not ignore_case:
        return value == pattern
    if re.fullmatch(r"[^*?\[\\]*\*", pattern) and not ignore_case:
        return value.startswith(pattern[:-1])
    return value.rlike(glob_to_regex(pattern, ignore_case))


def within_score(score: Column, low: str | float, high: str | float) -> Column:
    """Score bounds: a number, `(x` to leave x out, `-inf` and `+inf` for none."""

    def one(bound: str | float, is_low: bool) -> Column:
        text = str(bound)
        open_, text = text.startswith("("), text.lstrip("(")
        if text in ("-inf", "-") and is_low or text in ("+inf", "inf", "+") and not is_low:
            return F.lit(True)
        x = F.lit(float(text))
        return (score > x if open_ else score >= x) if is_low else (score < x if open_ else score <= x)

    return one(low, True) & one(high, False)


def within_lex(member: Column, low: str, high: str) -> Column:
    """Bounds in byte order: `[x` with x, `(x` without, `-` and `+` for none."""

    def one(bound: str, is_low: bool) -> Column:
        if bound == "-":
            return F.lit(is_low)
        if bound == "+":
            return F.lit(not is_low)
        if bound[:1] not in ("[", "("):
            raise ValueError("a lexicographic bound starts with [ or (, or is - or +")
        x = bound[1:]
        if is_low:
            return member >= x if bound[0] == "[" else member > x
        return member <= x if bound[0] == "[" else member < x

    return one(low, True) & one(high, False)


def from_end(index: Column | int, size: Column) -> Column:
    """An index where -1 is the last element, counted from the front."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.when(i < 0, i + size).otherwise(i)


def in_slice(position: Column, start: int, stop: int, size: Column) -> Column:
    """Whether a 0-based position lies in an inclusive slice; an empty slice holds nothing."""
    return (position >= F.greatest(from_end(start, size), F.lit(0))) & (position <= from_end(stop, size))


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes of an inclusive slice of a binary value, negatives from the end."""
    size = F.octet_length(value)
    lo = F.greatest(from_end(start, size), F.lit(0))
    hi = F.least(from_end(stop, size), size - 1)
    return F.when(lo <= hi, F.substring(value, lo + 1, hi - lo + 1)).otherwise(F.lit(b"")).cast("binary")


def overwrite(value: Column, offset: int, patch: Column) -> Column:
    """A binary value with `patch` written at an offset; a gap is filled with zero bytes."""
    v = F.coalesce(value, F.lit(b"")).cast("binary")
    p = patch.cast("binary")
    padded = F.when(F.octet_length(v) < offset, F.rpad(v, F.lit(offset), F.lit(b"\x00"))).otherwise(v)
    tail = F.substring(padded, F.lit(offset + 1) + F.octet_length(p), F.greatest(F.octet_length(padded) - offset - F.octet_length(p), F.lit(0)))
    out = F.concat(F.substring(padded, 1, offset), p, tail)
    return F.when(F.octet_length(p) == 0, v).otherwise(out)
