"""Conditions on JSON payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def present(payload: Column, key: str) -> Column:
    """Whether a dotted path exists; a JSON null is present. Broken or null JSON has no paths."""
    found = F.try_variant_get(F.try_parse_json(payload), path(key), "variant")
    return F.coalesce(found.isNotNull(), F.lit(False))


def matches(payload: Column, key: str, value: str | float | int | bool | None) -> Column:
    """JSON equality at a dotted path. Numbers are equal by value (1 and 1.0); a number never
    equals a text."""
    found = F.try_variant_get(F.try_parse_json(payload), path(key), "variant")
    if value is None:
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    kind = F.schema_of_variant(found)
    if isinstance(value, bool):
        same = (kind == "BOOLEAN") & (found.cast("string") == str(value).lower())
    elif isinstance(value, int | float):
        same = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (found.cast("string").try_cast("double") == float(value))
    else:
        same = (kind == "STRING") & (found.cast("string") == value)
    return F.coalesce(same, F.lit(False))


def condition(payload: Column, must=(), should=(), must_not=()) -> Column:
    """All of `must`, at least one of `should` if there are any, none of `must_not`.

    Each is a pair (dotted key, value), or a key alone for its presence.
    """
    one = lambda c: present(payload, c) if isinstance(c, str) else matches(payload, *c)
    out = F.lit(True)
    for c in must:
        out = out & one(c)
    if should:
        out = out & reduce(lambda a, b: a | b, [one(c) for c in should])
    for c in must_not:
        out = out & ~one(c)
    return out
