"""Choice between the exact scan and inverted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarryset.operators import ivf
from quarryset.operators.vectors import knn_batch

EXACT_BELOW = 10_000


def search(points: DataFrame, queries: DataFrame, k: int, config: ivf.IvfConfig, centroids: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Exact below `EXACT_BELOW` rows or without centroids, inverted lists above. No row is lost
    by the choice: lists are assigned on the fly if the table has none."""
    n = points.count() if rows is None else rows
    if centroids is None or n < EXACT_BELOW:
        return knn_batch(points, queries, k, config.metric)
    stored = points if "list_id" in points.columns else ivf.assign(points, centroids)
    return ivf.search(stored, centroids, queries, k, config)
