"""A varied subset: distributed farthest-first k-center.

1. Each point becomes one vector: its unit vector, and hashed features of its payload (the layout,
   and short words as values), so that the distance sees both.
2. Points go to cells of similar points (bounded size; a dense spot gets several cells). Each cell
   picks its own representatives farthest-first.
3. The representatives are pooled and picked from again, level by level while the pool is too
   large for one task, until one pool a collection is left.

A pick first covers what has support, that is at least `SUPPORT` similar points, until all of that
lies within `COVER` of a pick; only then do lone points follow. Otherwise lone points, which are far
from everything, would crowd out the small groups.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryset.llm.p1_clusters import hashed_features, nearest
from quarryset.llm.p2_neighbours import _sample, _split, blocks
from quarryset.llm.vectors import from_binary, point_vectors, spaces, to_binary, unit, unpack, unpack_list
from quarryset.runtime import Scratch

#: Points picked of each collection; slots and weight of payload features; similar points that
#: make support, and the cosine that makes them similar; distance that counts as covered; pool.
K, SLOTS, PAYLOAD, SUPPORT, NEAR, COVER, POOL = 200, 32, 0.2, 3, 0.6, 0.3, 20_000
#: Points aimed at for a cell and for each of its seeds, and most seeds of a collection. Support is
#: counted within a cell, so cells are larger than those of problem 2.
CELL, FINE, MOST_SEEDS = 10_000, 250, 1024
_WORD = re.compile(r"[^\W\d_]{1,24}")


def payload_features(payload: str | None) -> list[str]:
    """Names of features: paths of the JSON, and short words found at them. Null or broken JSON has
    one feature that says so. Case and blanks don't matter."""
    try:
        tree = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return ["broken"]
    if not isinstance(tree, dict):
        return ["none"]
    out: list[str] = []
    stack = [("", tree)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            out.append(f"{path}[]")
            stack += [(path, x) for x in v]
        elif isinstance(v, str) and _WORD.fullmatch(v.strip()):
            out.append(f"{path}={v.strip().lower()}")
        else:
            out.append(f"{path}:{type(v).__name__}")
    return sorted(set(out)) or ["none"]


def _payload_matrix(payloads: list[str | None]) -> np.ndarray:
    known: dict[str, np.ndarray] = {}
    out = np.zeros((len(payloads), SLOTS), np.float32)
    for i, p in enumerate(payloads):
        for name in payload_features(p):
            row = known.get(name)
            if row is None:
                row = known[name] = hashed_features([f"payload {name}"], np.ones((1, 1), np.float32), SLOTS)[0]
            out[i] += row
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1)[:, None]


def farthest_first(x: np.ndarray, support: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows picked, in order, and their distance to the picks before them (the first has 2).

    x has rows of length 1; the distance is 1 - dot. Ties go to the earlier row.
    """
    n = len(x)
    picks, gaps = [], []
    far = np.full(n, 2.0)
    supported = support >= SUPPORT
    while len(picks) < min(k, n):
        pool = np.where(supported, far, -1.0)
        if not picks:
            i = int(np.argmax(support))
        elif pool.max(initial=-1) >= COVER:
            i = int(pool.argmax())
        else:
            i = int(far.argmax())
            if far[i] <= 0:  # all that is left repeats a pick; rounding must not pick a row twice
                i = int(np.setdiff1d(np.arange(n), picks)[0])
        gaps.append(far[i])
        picks.append(i)
        far = np.minimum(far, 1 - x @ x[i])
        far[picks] = -2.0
    return np.array(picks, np.int64), np.array(gaps)


OUT = "space string, id bigint, feat binary, support bigint, rank int, gap double"


def subset(points: DataFrame, vectors: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(space, id, rank, gap, support): up to k points of each space.

    `points` is (space, id, payload), `vectors` (space, id, vec); points without a usable vector
    don't take part. Of rows with one id the smallest payload counts.
    """
    spark = vectors.sparkSession
    one = points.groupBy("space", "id").agg(F.min("payload").alias("payload"))
    data = scratch.write(vectors.dropDuplicates(["space", "id"]).join(one, ["space", "id"], "left"), "points")
    counts = {r.space: r["count"] for r in data.groupBy("space").count().collect()}
    if not counts:
        return spark.createDataFrame([], "space string, id bigint, rank int, gap double, support bigint")
    seeds = _sample(data, {s: min(MOST_SEEDS, math.ceil(n / FINE)) for s, n in counts.items()}, counts, 41)
    shared = spark.sparkContext.broadcast({s: (x, blocks(x, counts[s] / len(x), CELL)) for s, x in seeds.items()})

    def features(batches):
        for b in batches:
            for space, rows in spaces(b.column("space")):
                part = b.take(pa.array(rows))
                x = unit(unpack(part.column("vec")))
                seed, block = shared.value[space]
                f = np.concatenate([x * math.sqrt(1 - PAYLOAD), _payload_matrix(part.column("payload").to_pylist()) * math.sqrt(PAYLOAD)], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("space"), part.column("id"), pa.array(block[nearest(x, seed)[1]]), to_binary(f)], names=["space", "id", "cell", "feat"])

    def pick(t: pa.Table, support: np.ndarray, x: np.ndarray) -> pa.Table:
        p, gaps = farthest_first(x, support, k)
        return pa.table({"space": t.column("space").take(pa.array(p)), "id": t.column("id").take(pa.array(p)), "feat": t.column("feat").take(pa.array(p)), "support": pa.array(support[p], pa.int64()), "rank": pa.array(np.arange(1, len(p) + 1), pa.int32()), "gap": gaps})

    def in_cell(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
        x = from_binary(t.column("feat"))
        v = np.ascontiguousarray(x[:, :-SLOTS])
        part, out = _split(v, t.column("id").to_numpy(), CELL), []
        for one in np.unique(part):  # cells are bounded; what outgrows them is split where it lies
            p = np.flatnonzero(part == one)
            y = v[p]
            step = max(1, 8_000_000 // len(y))
            support = np.concatenate([(y[s : s + step] @ y.T >= NEAR * (1 - PAYLOAD)).sum(1) for s in range(0, len(y), step)])
            out.append(pick(t.take(pa.array(p)), support, x[p]))
        return pa.concat_tables(out)

    def again(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
        return pick(t, t.column("support").to_numpy(), from_binary(t.column("feat")))

    pool = scratch.write(data.mapInArrow(features, "space string, id bigint, cell int, feat binary").groupBy("space", "cell").applyInArrow(in_cell, OUT), "pool")
    largest = pool.groupBy("space").count().agg(F.max("count")).first()[0]
    while largest > max(POOL, 2 * k):
        groups = math.ceil(largest / max(POOL, 4 * k))
        smaller = scratch.write(pool.groupBy("space", F.pmod(F.xxhash64("id"), F.lit(groups))).applyInArrow(again, OUT), "pool")
        scratch.drop(pool)
        now = smaller.groupBy("space").count().agg(F.max("count")).first()[0]
        pool = smaller
        if now >= largest:
            break
        largest = now
    final = pool.groupBy("space").applyInArrow(again, OUT)
    return final.select("space", "id", "rank", F.round("gap", 6).alias("gap"), "support")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    points = spark.read.parquet(f"{sf}/points.parquet")
    return points.select(F.col("collection").alias("space"), F.col("uid").alias("id"), "payload"), point_vectors(points, spark.read.parquet(f"{sf}/collections.parquet"))


def p4_subset(spark: SparkSession, sf: str) -> DataFrame:
    s = subset(*_inputs(spark, sf), Scratch(spark, "p4"))
    return s.select(F.col("space").alias("collection"), F.col("id").alias("uid"), "rank", "gap", "support")


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How well the subset covers each collection: the cosine of its points to the nearest pick."""
    points, vectors = _inputs(spark, sf)
    scratch = Scratch(spark, "p4")
    chosen = subset(points, vectors, scratch).join(vectors.dropDuplicates(["space", "id"]), ["space", "id"]).select("space", "vec").collect()  # K a collection
    picks: dict[str, list[bytes]] = {}
    for space, vec in chosen:
        picks.setdefault(space, []).append(bytes(vec))
    shared = spark.sparkContext.broadcast({s: unit(unpack_list(v)) for s, v in picks.items()})

    def measure(batches):
        for b in batches:
            for space, rows in spaces(b.column("space")):
                top, _ = nearest(unit(unpack(b.column("vec").take(pa.array(rows)))), shared.value[space])
                yield pa.RecordBatch.from_arrays([pa.array([space] * len(top), pa.string()), pa.array(top.astype(np.float64))], names=["collection", "cosine"])

    near = vectors.mapInArrow(measure, "collection string, cosine double")
    return near.groupBy("collection").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("cosine"), 4).alias("mean_cosine"), F.round(F.avg((F.col("cosine") >= 0.6).cast("double")), 4).alias("near_share"))
