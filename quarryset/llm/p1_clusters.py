"""Groups of mutually similar records: k-means with parallel oversampled seeding.

Cost at scale. Every step is a pass over the vectors with a bounded block of centres (broadcast;
at most `BLOCK` of them), or works in cells of bounded size. No vector is shuffled except those
that no large group has taken, three times, to their nearest cells.

1. Vectorise: the records here are dense vectors already and are taken as they are; `cluster`
   hashes nothing. `hashed_features`, which would leave them unchanged, is for records of named
   features (the payloads of problem 4).
2. Seed: `ROUNDS` passes, each drawing up to `OVERSAMPLE` records per space with a chance in
   proportion to their distance to the nearest seed (weighted reservoir keys, so one pass does it).
3. Lloyd passes with merging of centres that turn out to lie in one group.
4. Sampling cannot promise a group of five among millions. Records that no group has taken go to
   cells (their three nearest of a few sampled records). In each cell the dense spots become
   further seeds, which are refined over all records left, block by block.
5. One last pass assigns every record; a group stays if it meets the stated bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.llm.vectors import from_binary, point_vectors, spaces, to_binary, unit, unit64, unpack, unpack_list, usable
from quarryset.runtime import Scratch

ROUNDS, OVERSAMPLE, BLOCK, CELL = 3, 384, 16384, 2000
#: Bounds of a group (TESTDATA.md): members to the mean, others to the mean, least size.
INSIDE, OUTSIDE, LEAST = 0.85, 0.80, 5
#: Two records closer than NEAR may share a group; centres closer than SAME are of one group.
NEAR, SAME = 0.6, 0.75


def hashed_features(names: list[str], weights: np.ndarray, slots: int) -> np.ndarray:
    """Signed feature hashing: weight of each feature, added at its slot with its sign.

    Names that are decimal numbers below `slots` are their own slots with sign plus: a dense
    vector of at most `slots` coordinates passes unchanged.
    """
    out = np.zeros((len(weights), slots), np.float32)
    for j, name in enumerate(names):
        if name.isdigit() and int(name) < slots:
            out[:, int(name)] += weights[:, j]
        else:
            h = xxhash.xxh64_intdigest(name)
            out[:, (h >> 1) % slots] += weights[:, j] * (1 if h & 1 else -1)
    return out


def _chance(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on id and salt only."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mul)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine to, and place of, the nearest centre of each row of unit vectors."""
    top, at = np.full(len(x), -2, np.float32), np.zeros(len(x), np.int64)
    if len(centres):
        step = max(1, 4_000_000 // len(centres))
        for s in range(0, len(x), step):
            sims = x[s : s + step] @ centres.T
            at[s : s + step] = a = sims.argmax(1)
            top[s : s + step] = np.take_along_axis(sims, a[:, None], 1)[:, 0]
    return top, at


def _each(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for space, rows in spaces(b.column("space")):
            part = b.take(pa.array(rows))
            raw = unpack(part.column("vec"))
            yield space, part, raw, unit(raw)


def _seed(vectors: DataFrame, centres: dict[str, np.ndarray], salt: int, per_space: int) -> dict[str, np.ndarray]:
    """Draws up to `per_space` records per space that lie far from the centres."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def draw(batches):
        for space, part, _, x in _each(batches):
            ids = part.column("id").to_numpy(zero_copy_only=False)
            top, _ = nearest(x, shared.value.get(space, np.zeros((0, x.shape[1]), np.float32)))
            cost = np.where(top < NEAR, 1 - np.maximum(top, -1), 0)
            rows = np.flatnonzero(cost > 0)
            if not len(rows):
                continue
            key = -np.log(_chance(ids[rows], salt)) / cost[rows]
            if len(rows) > per_space:
                pick = np.argpartition(key, per_space)[:per_space]
                rows, key = rows[pick], key[pick]
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(rows), pa.string()), pa.array(key), part.column("vec").take(pa.array(rows))], names=["space", "key", "vec"])

    drawn = vectors.mapInArrow(draw, "space string, key double, vec binary")
    w = W.partitionBy("space").orderBy("key", "vec")
    got = drawn.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_space).select("space", "_n", "vec").collect()
    shared.unpersist()
    out: dict[str, list[bytes]] = {}
    for space, _, vec in sorted(got):
        out.setdefault(space, []).append(bytes(vec))
    return {s: unit(unpack_list(v)) for s, v in out.items()}


def _sums(vectors: DataFrame, centres: dict[str, np.ndarray], least: float) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per centre: sum of the unit vectors nearest to it (at `least` or more), number, least cosine.

    Each task adds up its rows before anything moves; the driver gets one row per centre (bounded
    by the block of centres)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def add(batches):
        acc: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for space, _, _, x in _each(batches):
            c = shared.value.get(space)
            if c is None or not len(c):
                continue
            top, at = nearest(x, c)
            ok = np.flatnonzero(top >= least)
            if space not in acc:
                acc[space] = np.zeros((len(c), c.shape[1])), np.zeros(len(c), np.int64), np.full(len(c), 2.0)
            total, number, low = acc[space]
            order = ok[np.argsort(at[ok], kind="stable")]
            if len(order):
                keys, first = np.unique(at[order], return_index=True)
                total[keys] += np.add.reduceat(x[order].astype(np.float64), first, axis=0)
                number[keys] += np.diff(np.append(first, len(order)))
                low[keys] = np.minimum(low[keys], np.minimum.reduceat(top[order].astype(np.float64), first))
        for space, (total, number, low) in acc.items():
            hit = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(hit), pa.string()), pa.array(hit), pa.array(number[hit]), pa.array(low[hit]), to_binary(total[hit])], names=["space", "at", "n", "low", "total"])

    def merge(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        space, at = table.column("space")[0].as_py(), table.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        keys, first = np.unique(at[order], return_index=True)
        total = np.add.reduceat(from_binary(table.column("total"), np.float64)[order], first, axis=0)
        return pa.table({"space": [space] * len(keys), "at": keys, "n": np.add.reduceat(table.column("n").to_numpy()[order], first), "low": np.minimum.reduceat(table.column("low").to_numpy()[order], first), "total": to_binary(total)})

    schema = "space string, at bigint, n bigint, low double, total binary"
    partial = vectors.mapInArrow(add, schema)
    rows = partial.groupBy("space", F.floor(F.col("at") / 512).alias("_b")).applyInArrow(merge, schema).collect()
    shared.unpersist()
    out = {}
    for space, c in centres.items():
        mine = sorted((r for r in rows if r.space == space), key=lambda r: r.at)
        at = np.array([r["at"] for r in mine], np.int64)
        total = np.frombuffer(b"".join(bytes(r.total) for r in mine), np.float64).reshape(len(mine), c.shape[1]) if mine else np.zeros((0, c.shape[1]))
        out[space] = at, total, np.array([r.n for r in mine], np.int64), np.array([r.low for r in mine])
    return out


def _merge(total: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins centres of one group, largest first; returns unit means and numbers."""
    if not len(total):
        return np.zeros((0, total.shape[1] if total.ndim == 2 else 0), np.float32), np.zeros(0, np.int64)
    order = np.argsort(-number, kind="stable")
    total, number = total[order], number[order]
    mean = unit(total)
    owner = np.full(len(mean), -1)
    for i in range(len(mean)):
        if owner[i] < 0:
            free = np.flatnonzero(owner[i:] < 0) + i
            owner[free[mean[free] @ mean[i] >= SAME]] = i
            owner[i] = i
    keys, at = np.unique(owner, return_inverse=True)
    sums, n = np.zeros((len(keys), total.shape[1])), np.zeros(len(keys), np.int64)
    np.add.at(sums, at, total)
    np.add.at(n, at, number)
    return unit(sums), n


def _refine(vectors: DataFrame, centres: dict[str, np.ndarray], steps=(NEAR, 0.7, OUTSIDE, OUTSIDE), valid: float = LEAST) -> dict[str, np.ndarray]:
    """Lloyd passes with rising bounds; keeps centres of at least `LEAST` records."""
    for i, least in enumerate(steps):
        if not any(len(c) for c in centres.values()):
            break
        got = _sums(vectors, centres, least)
        new = {}
        for space, (_, total, n, _) in got.items():
            keep = n >= (valid if i >= 1 else 2)
            new[space] = _merge(total[keep], n[keep])[0]
        still = i >= 2 and all(new[s].shape == c.shape and len(c) and np.abs(np.einsum("ij,ij->i", new[s], c)).min(initial=1) > 1 - 1e-9 for s, c in centres.items())
        centres = {s: c for s, c in new.items() if len(c)}
        if still:
            break
    return centres


def _rest(vectors: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """Records that no centre has taken."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def left(batches):
        for space, part, _, x in _each(batches):
            top, _ = nearest(x, shared.value.get(space, x[:0]))
            rows = np.flatnonzero(top < OUTSIDE)
            if len(rows):
                yield part.take(pa.array(rows)).select(["space", "id", "vec"])

    return vectors.mapInArrow(left, "space string, id bigint, vec binary")


def _spots(x: np.ndarray) -> np.ndarray:
    """Means of the dense spots among unit vectors; cells too large for one matrix are split."""
    if len(x) > 4 * CELL:
        seeds = x[:: len(x) // math.ceil(len(x) / CELL)]
        at = nearest(x, seeds)[1]
        split = [x[at == j] for j in range(len(seeds))]
        if max(map(len, split)) < len(x):
            return np.concatenate([_spots(p) for p in split if len(p) >= 3] or [x[:0]])
    out, free = [], np.ones(len(x), bool)
    degree = np.concatenate([(x[s : s + 1000] @ x.T >= NEAR).sum(1) for s in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < 3:
            break
        if not free[i]:
            continue
        mean = x[i]
        for least in (NEAR, 0.7, SAME):
            members = x @ mean >= least
            if members.sum() < 3:
                break
            mean = x[members].mean(0)
            mean /= np.linalg.norm(mean)
        free[i] = False
        members = x @ mean >= SAME
        if members.sum() >= 3:
            free[members] = False
            out.append(mean)
    return np.array(out, np.float32).reshape(len(out), x.shape[1])


def _cell_spots(rest: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Candidate centres (space, block, vec) from cells of the records left."""
    want = {s: min(2048, math.ceil(n / CELL)) for s, n in counts.items()}
    seeds = _seed(rest, {}, 99, max(want.values(), default=1))
    seeds = {s: v[: want[s]] for s, v in seeds.items()}
    shared = rest.sparkSession.sparkContext.broadcast(seeds)

    def spread(batches):
        for space, part, _, x in _each(batches):
            c = shared.value[space]
            m = min(3, len(c))
            cells = np.argpartition(-(x @ c.T), m - 1, axis=1)[:, :m] if len(c) > m else np.tile(np.arange(m), (len(x), 1))
            rows = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(rows), pa.string()), pa.array(cells.ravel().astype(np.int32)), part.column("vec").take(pa.array(rows))], names=["space", "cell", "vec"])

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        spots = _spots(unit(unpack(table.column("vec"))))
        return pa.table({"space": pa.array([key[0].as_py()] * len(spots), pa.string()), "cell": pa.array([key[1].as_py()] * len(spots), pa.int32()), "vec": to_binary(spots)})

    return rest.mapInArrow(spread, "space string, cell int, vec binary").groupBy("space", "cell").applyInArrow(find, "space string, cell int, vec binary")


def _assign(vectors: DataFrame, centres: list[tuple[str, np.ndarray, int]]) -> DataFrame:
    """(space, id, centre, cosine) of the records that one of these centres takes."""
    shared = vectors.sparkSession.sparkContext.broadcast({s: (c.astype(np.float32), c, base) for s, c, base in centres})

    def take(batches):
        for space, part, raw, x in _each(batches):
            c32, c64, base = shared.value.get(space, (x[:0], x[:0], 0))
            top, at = nearest(x, c32)
            rows = np.flatnonzero(top >= OUTSIDE - 1e-4)
            if not len(rows):
                continue
            cos = np.einsum("ij,ij->i", unit64(raw[rows]), c64[at[rows]])
            ok = cos >= OUTSIDE
            rows, cos = rows[ok], cos[ok]
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(rows), pa.string()), part.column("id").take(pa.array(rows)), pa.array(at[rows] + base), pa.array(cos)], names=["space", "id", "centre", "cosine"])

    return vectors.mapInArrow(take, "space string, id bigint, centre bigint, cosine double")


def cluster(vectors: DataFrame) -> DataFrame:
    """Groups of (space, id, vec): one row (space, id, group_id, cosine) per record in a group.

    A group has at least 5 records of one space, each with a cosine of at least 0.85 to the
    group's mean, while every other record stays below 0.8. Records in no group have no row.
    `group_id` is the smallest id of the group. Repeated rows count once; an empty input gives an
    empty result. An id with several different vectors counts as several records.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "p1")
    data = scratch.write(vectors.distinct(), "vectors")
    centres: dict[str, np.ndarray] = {}
    for r in range(ROUNDS):
        for space, more in _seed(data, centres, r, OVERSAMPLE).items():
            centres[space] = np.concatenate([centres[space], more]) if space in centres else more
    centres = _refine(data, centres)
    found: dict[str, list[np.ndarray]] = {s: [c] for s, c in centres.items()}
    rest = scratch.write(_rest(data, centres), "rest")
    counts = {r.space: r["count"] for r in rest.groupBy("space").count().collect()}
    if counts:
        spots = scratch.write(_cell_spots(rest, counts), "spots")
        blocks = max(1, math.ceil(spots.count() / BLOCK))
        for b in range(blocks):
            rows = spots.filter(F.pmod(F.xxhash64("space", "cell"), F.lit(blocks)) == b).select("space", "vec").collect()
            block: dict[str, list[bytes]] = {}
            for space, vec in rows:
                block.setdefault(space, []).append(bytes(vec))
            new = {}
            for space, vecs in block.items():
                m = np.frombuffer(b"".join(sorted(vecs)), np.float32).reshape(len(vecs), -1)
                new[space] = _merge(m.astype(np.float64), np.ones(len(m), np.int64))[0]
            new = _refine(rest, new, (0.7, OUTSIDE, OUTSIDE))
            for space, c in new.items():
                found.setdefault(space, []).append(c)
            if b + 1 < blocks and new:
                smaller = scratch.write(_rest(rest, new), "rest")
                scratch.drop(rest)
                rest = smaller
        scratch.drop(spots)
    scratch.drop(rest)
    out, base = None, 0
    for space in sorted(found):
        found[space] = [np.concatenate(found[space])]
    for start in range(0, max((len(c[0]) for c in found.values()), default=0), BLOCK):
        block = []
        for space in sorted(found):
            c = found[space][0][start : start + BLOCK]
            if len(c):
                block.append((space, c.astype(np.float64) / np.linalg.norm(c.astype(np.float64), axis=1)[:, None], base))
                base += len(c)
        part = _assign(data, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "space string, id bigint, group_id bigint, cosine double")
    taken = scratch.write(out, "taken")
    groups = taken.groupBy("space", "centre").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("_n"), F.min("cosine").alias("_low")).filter((F.col("_n") >= LEAST) & (F.col("_low") >= INSIDE - 1e-6))
    return taken.join(groups, ["space", "centre"]).select("space", "id", "group_id", "cosine")


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """Size, least and mean cosine of each group, and its members nearest the centre."""
    w = W.partitionBy("space", "group_id").orderBy(F.desc("cosine"), "id")
    near = members.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= typical).groupBy("space", "group_id").agg(F.sort_array(F.collect_list(F.struct("_n", "id"))).alias("_t"))
    stats = members.groupBy("space", "group_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.min("cosine"), 6).alias("least_cosine"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))
    return stats.join(near, ["space", "group_id"]).select("space", "group_id", "size", "least_cosine", "mean_cosine", F.col("_t.id").alias("typical"))


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    points, colls, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("points", "collections", "doc_records"))
    pv = point_vectors(points, colls).withColumn("space", F.concat(F.lit("points/"), "space"))
    return pv.unionByName(usable(docs, F.lit("doc_records/"), "doc_id", "pooled", F.lit(64)))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    m = cluster(inputs(spark, sf))
    return m.select(F.substring_index("space", "/", 1).alias("tbl"), F.col("id").alias("rec_id"), "group_id").distinct()


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return describe(cluster(inputs(spark, sf)))
