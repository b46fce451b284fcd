"""Collections of points (collection, id, vector, payload) and nearest-neighbour search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarryset.functions.distance import SIMILARITIES, score

#: Bytes of query vectors that are broadcast at once; more queries take more passes.
QUERY_BLOCK = 64 << 20


def usable(vector: Column, dim: int) -> Column:
    """Right length, no null, NaN or infinite element."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, bad), F.lit(False))


def knn(points: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The k points nearest to a query, exact, with `score`, best first; ties by id.

    Conditions apply before the search, so it never comes back short. `cosine` and `dot` are
    similarities, `l2` a distance; `threshold` bounds them accordingly. A top-k, not a sort.
    """
    rows = points if where is None else points.filter(where)
    rows = rows.filter(usable(F.col(vector), len(query))).withColumn("score", F.round(score(F.col(vector), query, metric), 6))
    better = F.desc if metric in SIMILARITIES else F.asc
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold if metric in SIMILARITIES else F.col("score") <= threshold)
    return rows.orderBy(better("score"), id_col).limit(k)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(len(lists), -1).astype(np.float64)


def knn_batch(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", dim: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest of each query (qid, vector), exact.

    Each task scores its points against a block of queries by one matrix product and keeps k a
    query, so that only tasks x queries x k rows are shuffled. Blocks have a bounded size.
    """
    dim = dim or queries.select(F.max(F.size("vector"))).first()[0] or 0
    asked = queries.filter(usable(F.col("vector"), dim)).select("qid", "vector")
    blocks = max(1, math.ceil(asked.count() * dim * 8 / QUERY_BLOCK))
    spark, sign = points.sparkSession, 1.0 if metric in SIMILARITIES else -1.0
    rows = points.filter(usable(F.col(vector), dim)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    id_kind, q_kind = rows.schema["id"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
    id_arrow, q_arrow = (to_arrow_type(d.schema[c].dataType) for d, c in ((rows, "id"), (asked, "qid")))
    out = None
    for b in range(blocks):
        mine = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).orderBy("qid").collect()
        shared = spark.sparkContext.broadcast(([r.qid for r in mine], np.array([r.vector for r in mine], np.float64).reshape(len(mine), dim)))

        def best(batches, shared=shared):
            qids, q = shared.value
            if not len(qids):
                return
            kept_row, kept_id, kept_score = np.zeros(0, np.int64), None, np.zeros(0)
            lengths = np.sqrt((q * q).sum(1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1))
                ids = np.array(batch.column(0).to_pylist())  # numbers, or texts in the order of code points
                own = np.sqrt((x * x).sum(1))
                new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                step = max(1, 4_000_000 // len(x))
                for f in range(0, len(q), step):
                    s = q[f : f + step] @ x.T
                    n = lengths[f : f + step, None]
                    if metric == "cosine":
                        both = n * own[None]
                        s = np.where(both > 0, s / np.where(both > 0, both, 1), 0.0)
                    elif metric == "l2":
                        s = -np.sqrt(np.maximum(0, n * n + own[None] ** 2 - 2 * s))
                    s = np.round(s, 6)
                    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
                    r, c = np.nonzero(s >= edge)
                    new.append((r + f, ids[c], s[r, c]))
                row = np.concatenate([kept_row, *(t[0] for t in new)])
                who = np.concatenate([*([] if kept_id is None else [kept_id]), *(t[1] for t in new)])
                score_ = np.concatenate([kept_score, *(t[2] for t in new)])
                order = np.lexsort((who, -score_, row))
                rank = np.arange(len(order)) - np.searchsorted(row[order], np.arange(len(q)))[row[order]]
                order = order[rank < k]
                kept_row, kept_id, kept_score = row[order], who[order], score_[order]
            for f in range(0, len(kept_row), 50_000):
                e = slice(f, f + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in kept_row[e]], q_arrow), pa.array(kept_id[e].tolist(), id_arrow), pa.array(kept_score[e] * sign + 0.0)], names=["qid", "id", "score"])

        part = rows.mapInArrow(best, f"qid {q_kind}, id {id_kind}, score double")
        out = part if out is None else out.unionByName(part)
    order = F.desc("score") if sign > 0 else F.asc("score")
    w = W.partitionBy("qid").orderBy(order, "id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def knn_join(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(qid, id, score, rank): the k nearest points of each row of another table, of any size. The
    queries are taken in blocks of bounded bytes (`knn_batch`); no pairs are shuffled."""
    return knn_batch(points, queries, k, metric)


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points after upserts (.., seq): a known (collection, id) is replaced by its last version."""
    cols = [c for c in points.columns if c not in ("collection", "id")]
    last = new.groupBy("collection", "id").agg(F.max_by(F.struct(*cols), "seq").alias("_p")).select("collection", "id", *[F.col("_p")[c].alias(c) for c in cols])
    return points.join(last.select("collection", "id"), ["collection", "id"], "left_anti").unionByName(last.select(*points.columns))


def delete(points: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Without the given (collection, id), or without the points that meet a condition."""
    if ids is not None:
        return points.join(ids.select("collection", "id"), ["collection", "id"], "left_anti")
    return points.filter(~F.coalesce(where, F.lit(False)))


def scroll(points: DataFrame, limit: int, after=None, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """One page in the order of ids, after the last id of the page before."""
    page = points if where is None else points.filter(where)
    if after is not None:
        page = page.filter(F.col(id_col) > F.lit(after))
    return page.orderBy(id_col).limit(limit)


def collection_info(points: DataFrame, collections: DataFrame) -> DataFrame:
    """Name, dimension, metric and number of distinct points of every collection."""
    n = points.groupBy("collection").agg(F.count_distinct("id").alias("points"))
    return collections.join(n, F.col("name") == F.col("collection"), "left").select("name", "dim", "metric", F.coalesce("points", F.lit(0)).alias("points"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): share of the true neighbours (qid, id) that were found."""
    hit = truth.join(found.select("qid", "id").distinct().withColumn("_f", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("_f") / F.count(F.lit(1))).alias("recall"))


def create_collection(collections: DataFrame, name: str, dim: int, metric: str = "cosine", m: int = 16, ef_construction: int = 200) -> DataFrame:
    """The collections with a new one; one that exists stays as it is."""
    row = collections.sparkSession.createDataFrame([(name, dim, metric, m, ef_construction)], "name string, dim int, metric string, m int, ef_construction int")
    return collections.unionByName(row.join(collections.select("name"), "name", "left_anti").select(*collections.columns))


def drop_collection(collections: DataFrame, points: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Collections and points without one collection."""
    return collections.filter(~F.col("name").eqNullSafe(F.lit(name))), points.filter(~F.col("collection").eqNullSafe(F.lit(name)))


def collection_exists(collections: DataFrame, names: list[str]) -> DataFrame:
    """(name, found) of the asked names."""
    asked = collections.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    there = collections.select("name").distinct().withColumn("_f", F.lit(True))
    return asked.join(there, "name", "left").select("name", F.coalesce("_f", F.lit(False)).alias("found"))


def get_points(points: DataFrame, ids: DataFrame, with_payload: bool = True, with_vector: bool = False) -> DataFrame:
    """Points of asked (collection, id), with what is asked for beside; unknown ids have no row."""
    cols = ["collection", "id", *(["payload"] if with_payload else []), *(["vector"] if with_vector else [])]
    return points.select(*cols).join(ids.select("collection", "id").distinct(), ["collection", "id"], "left_semi")
