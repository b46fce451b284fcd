"""Inverted lists: vectors stored by their nearest centroid; a query reads a few lists only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.functions.distance import score
from quarryset.operators import quantize
from quarryset.operators.vectors import knn


@dataclass(frozen=True)
class IvfConfig:
    """`codec` is `flat`, `sq8` or `pq`; the codes of the last two pick candidates, exact scores decide."""

    lists: int = 1024
    probes: int = 32
    rounds: int = 25
    codec: str = "flat"
    metric: str = "cosine"


def train(points: DataFrame, config: IvfConfig, seed: int = 7, sample: int = 200_000) -> DataFrame:
    """(list_id, centroid) by k-means over at most `sample` points (bounded, chosen by hash)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=config.lists, maxIter=config.rounds, seed=seed, initMode="k-means||").fit(rows)
    return points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")


def _matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centroids, collected: `lists` rows of the index's configuration."""
    rows = centroids.orderBy("list_id").collect()
    return np.array([r.list_id for r in rows], np.int64), np.array([r.centroid for r in rows], np.float64)


def _ranked(x: np.ndarray, ids: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of each row, nearest first; ties take the smaller id."""
    d = np.round(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T), 9)
    return ids[np.argsort(d, axis=1, kind="stable")[:, :n]]


def _nearest_lists(rows: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """Adds `_lists`, the n nearest lists: one matrix product a batch, no shuffle. Null vectors, and
    those of another length than the centroids, get list -1."""
    shared = rows.sparkSession.sparkContext.broadcast(_matrix(centroids))

    def run(batches):
        ids, c = shared.value
        for b in batches:
            v = b.column(b.schema.get_field_index("_v"))
            size, dim = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False), c.shape[1] if len(c) else 0
            ok = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
            near = np.full((b.num_rows, min(n, max(1, len(ids)))), -1, np.int64)
            if len(ok):
                x = v.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), dim)
                near[ok] = _ranked(x, ids, c, n)
            keep = [m for m in b.schema.names if m != "_v"]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(m)) for m in keep), lists], names=[*keep, "_lists"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_v", F.col("vector").cast("array<double>")).mapInArrow(run, f"{schema}, _lists array<int>")


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds `list_id`, the nearest centroid (ties: the smaller), -1 for vectors of another length."""
    return _nearest_lists(points, centroids, 1).withColumn("list_id", F.col("_lists")[0]).drop("_lists")


def probes(centroids: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, query, list_id): the n lists nearest to each query (qid, vector)."""
    return _nearest_lists(queries.select("qid", "vector"), centroids, n).select("qid", F.col("vector").alias("query"), F.explode("_lists").alias("list_id")).filter("list_id >= 0")


def encode(stored: DataFrame, config: IvfConfig, dim: int, m: int = 8, nbits: int = 8) -> tuple[DataFrame, DataFrame | None]:
    """Adds `codes` to (id, vector, list_id) by the configured codec, and returns what decodes them
    (ranges or a codebook; None for `flat`)."""
    if config.codec == "flat":
        return stored, None
    if config.codec == "sq8":
        ranges = quantize.sq8_train(stored)
        return quantize.sq8_encode(stored, ranges), ranges
    if config.codec == "pq":
        book = quantize.pq_train(stored, m, 1 << nbits, dim, config.rounds)
        return stored.join(quantize.pq_assign(stored, book, m, dim), "id"), book
    raise ValueError(f"unknown codec {config.codec}")


def search(stored: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, config: IvfConfig, decoder: DataFrame | None = None, oversample: int = 4) -> DataFrame:
    """(qid, id, score, rank). `stored` has `list_id`; if it is partitioned by it on disk, the join
    with the probes prunes its partitions at run time.

    With the codecs `sq8` and `pq` (`stored` and `decoder` from `encode`) the codes pick
    `oversample` x k candidates of each query, whose exact scores decide.
    """
    order = F.asc("score") if config.metric == "l2" else F.desc("score")
    w = W.partitionBy("qid").orderBy(order, "id")
    asked = probes(centroids, queries, config.probes)
    if config.codec != "flat":
        coded = stored.select("id", "list_id", "codes")
        decoded = quantize.sq8_decode(coded, decoder) if config.codec == "sq8" else quantize.pq_decode(coded, decoder)
        rough = decoded.join(asked, "list_id").select("qid", "id", F.round(score(F.col("decoded"), F.col("query"), config.metric), 6).alias("score"))
        few = rough.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k * oversample).select("qid", "id")
        hits = few.join(stored.select("id", "vector"), "id").join(queries.select("qid", F.col("vector").alias("query")), "qid")
    else:
        hits = stored.join(asked, "list_id")
    hits = hits.select("qid", "id", F.round(score(F.col("vector"), F.col("query"), config.metric), 6).alias("score"))
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def two_stage(points: DataFrame, candidates: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """Exact order of candidates (id) that codes have picked; k of them."""
    return knn(points.join(candidates.select("id"), "id", "left_semi"), query, k, metric)
