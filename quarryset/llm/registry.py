"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quarryset.llm import p1_clusters, p2_neighbours, p3_percentiles, p4_subset, p5_history, p6_tokens, p7_leaks, p8_truncated

QUERIES = {
    "p1_found": p1_clusters.p1_found,
    "p1_groups": p1_clusters.p1_groups,
    "p2_found": p2_neighbours.p2_found,
    "p2_neighbours": p2_neighbours.p2_neighbours,
    "p2_search": p2_neighbours.p2_search,
    "p3_percentiles": p3_percentiles.p3_percentiles,
    "p3_spans": p3_percentiles.p3_spans,
    "p4_subset": p4_subset.p4_subset,
    "p4_coverage": p4_subset.p4_coverage,
    "p5_found": p5_history.p5_found,
    "p5_batches": p5_history.p5_batches,
    "p6_ids": p6_tokens.p6_ids,
    "p6_roundtrip": p6_tokens.p6_roundtrip,
    "p7_found": p7_leaks.p7_found,
    "p7_regions": p7_leaks.p7_regions,
    "p7_items": p7_leaks.p7_items,
    "p8_found": p8_truncated.p8_found,
    "p8_sources": p8_truncated.p8_sources,
}
SQL: dict[str, str] = {
    "p3_percentiles": p3_percentiles.P3_SQL,
    **p2_neighbours.SQL,
    **p5_history.SQL,
}
