"""SORT: elements ordered by themselves or by weights held under constructed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by(elements: DataFrame, weights: DataFrame | None = None, by: str | None = None, get: dict[str, DataFrame] | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """(element, ...) sorted. `by` is a pattern such as `weight_*`; `weights` and the tables of
    `get` are (key, value), looked up under the pattern with `*` replaced by the element.

    What is missing or no number weighs 0.0 (or '' with `alpha`); ties are ordered by the element.
    With a count the order is a top-k, not a full sort.
    """
    out, kind = elements.select("element"), F.col("element")
    if by is not None and weights is not None:
        head, _, tail = by.partition("*")
        w = weights.select(F.col("key").alias("_k"), F.col("value").alias("_w"))
        out = out.join(w, F.concat(F.lit(head), F.col("element").cast("string"), F.lit(tail)) == F.col("_k"), "left").drop("_k")
        kind = F.col("_w")
    weight = F.coalesce(kind.cast("string"), F.lit("")) if alpha else F.coalesce(kind.try_cast("double"), F.lit(0.0))
    out = out.withColumn("_by", weight)
    for i, (pattern, table) in enumerate((get or {}).items()):
        head, _, tail = pattern.partition("*")
        g = table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"get_{i}"))
        out = out.join(g, F.concat(F.lit(head), F.col("element").cast("string"), F.lit(tail)) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    out = out.orderBy(F.desc("_by") if descending else F.asc("_by"), F.desc("element") if descending else F.asc("element"))
    if offset:
        out = out.offset(offset)
    if count is not None:
        out = out.limit(count)
    return out.drop("_by", "_w")


def store(ordered: DataFrame, target) -> DataFrame:
    """The result of a sort as the list of a key (key, pos, value). It is one top-k or one list, whose
    order is taken as it comes: numbered by partition and row, which keep the order of a sort."""
    from quarryset.operators.lists import renumbered

    value = ordered.columns[1] if len(ordered.columns) > 1 else "element"
    rows = ordered.select(F.lit(target).alias("key"), F.monotonically_increasing_id().alias("pos"), F.col(value).cast("string").alias("value"))
    return renumbered(rows)
