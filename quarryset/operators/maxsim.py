"""Late interaction: documents of many vectors, scored by the sum of best matches of query tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryset.functions.distance import dot
from quarryset.operators.vectors import knn


def maxsim(patches: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, score) for patches (doc_id, vector) and query tokens (token, vector).

    The best patch of each token is found by partial aggregation, so a document's patches need not
    meet in one task. Tokens are one query: few.
    """
    pairs = patches.alias("p").crossJoin(F.broadcast(tokens).alias("t")).select("p.doc_id", "t.token", dot(F.col("p.vector"), F.col("t.vector")).alias("_s"))
    best = pairs.groupBy("doc_id", "token").agg(F.max("_s").alias("_s"))
    return best.groupBy("doc_id").agg(F.round(F.sum("_s"), 6).alias("score"))


def decode(coded: DataFrame) -> DataFrame:
    """Patches behind block codes (codes, scale)."""
    return coded.select("doc_id", "patch_no", F.expr("transform(codes, c -> c * scale / 127D)").alias("vector"))


def search(pooled: DataFrame, patches: DataFrame, query: list[float], tokens: DataFrame, candidates: int = 100, limit: int = 10, offset: int = 0) -> DataFrame:
    """Stage 1: documents by the cosine of their pooled vector. Stage 2: MaxSim of these, paged."""
    first = knn(pooled, query, candidates, "cosine", id_col="doc_id").select("doc_id")
    few = patches.join(first, "doc_id", "left_semi")
    return maxsim(few, tokens).orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
