"""Deduplicating new batches against all history with a pivot-distance table.

The history is stored as (space, pivot, theta, ring, ord, vec): each vector under its nearest of a
few fixed pivots, with its angle to it, range-partitioned and sorted by (space, pivot, theta).
Beside it lies a small table of how many rows each ring of a pivot holds. Angles between unit
vectors are a metric, so a vector within `radius` of a query

* lies within `radius` of the query's own angle to that pivot (ring bound), and
* cannot belong to a pivot whose half-space lies farther than the radius from the query
  (hyperplane bound, from the distances to the query's nearest pivots).

The pivots and angles that a batch can match are known before the history is touched. They become a
filter on the stored table, which the scan uses to skip files and row groups, and an exact join
with the rings visited drops the rest before anything is shuffled. A batch therefore meets only the
buckets that those bounds leave: ranges of neighbouring rings of a pivot that hold up to `BUCKET`
rows together. A ring with more rows is split by salt and its queries go to each part. What is left
is compared by matrix products and verified by the true cosine in double precision. New rows are
appended to the table; the history isn't rewritten (`compact` joins many small parts).

Equal vectors of a batch are one query, so that copies cost nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.llm.p1_clusters import nearest
from quarryset.llm.p2_neighbours import _sample
from quarryset.llm.vectors import point_vectors, spaces, unit, unit64, unpack, usable_sql
from quarryset.runtime import Scratch

#: Least cosine of a repeat; most pivots and sampled rows of a space; rows to a pivot; bucket size.
#: The pivots follow the number of rows up to what a task can compare a vector with.
LEAST, PIVOTS, SAMPLE, PER_PIVOT, BUCKET = 0.99, 2048, 4096, 4000, 8000
#: Ranges that are spelled out in a filter on the history; more are merged by space.
RANGES = 64
TABLE = "space string, pivot int, theta double, ring int, ord bigint, vec binary"


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """n pivots: centres of the densest spots first, then records far from all pivots."""
    sims = sample @ sample.T
    free, picked = np.ones(len(sample), bool), []
    degree = (sims >= 0.6).sum(1)
    for i in np.argsort(-degree, kind="stable"):
        if len(picked) >= n or degree[i] < 3:
            break
        if free[i]:
            free[sims[i] >= 0.6] = False
            picked.append(unit(sample[sims[i] >= 0.6].mean(0)[None])[0])
    if not picked:
        picked.append(sample[0])
    top = (sample @ np.array(picked).T).max(1)
    while len(picked) < min(n, len(sample)):
        i = int(top.argmin())
        picked.append(sample[i])
        top = np.maximum(top, sims[i])
    return np.array(picked, np.float32)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


class PivotHistory:
    """All that was accepted so far; `ord` gives the order of arrival."""

    def __init__(self, scratch: Scratch, pivots: dict[str, np.ndarray], least: float = LEAST):
        self.scratch, self.pivots, self.least = scratch, pivots, least
        self.radius = math.acos(least) + 1e-6
        self.parts: list[DataFrame] = []
        self.rings: list[DataFrame] = []

    @classmethod
    def begin(cls, vectors: DataFrame, scratch: Scratch, least: float = LEAST) -> PivotHistory:
        """Chooses pivots from a bounded sample of (space, id, vec); stores nothing yet."""
        counts = {r.space: r["count"] for r in vectors.groupBy("space").count().collect()}
        samples = _sample(vectors, {s: min(SAMPLE, n) for s, n in counts.items()}, counts, 21) if counts else {}
        return cls(scratch, {s: choose(x, min(PIVOTS, max(2, math.ceil(counts[s] / PER_PIVOT)))) for s, x in samples.items()}, least)

    def _rows(self, vectors: DataFrame) -> DataFrame:
        pivots, radius = vectors.sparkSession.sparkContext.broadcast(self.pivots), self.radius

        def place(batches):
            for b in batches:
                for space, rows in spaces(b.column("space")):
                    part = b.take(pa.array(rows))
                    x = unit(unpack(part.column("vec")))
                    cos, at = nearest(x, pivots.value[space]) if space in pivots.value else (np.zeros(len(x)), np.zeros(len(x), np.int64))
                    theta = np.arccos(np.clip(cos.astype(np.float64), -1, 1))
                    yield pa.RecordBatch.from_arrays([part.column("space"), pa.array(at.astype(np.int32)), pa.array(theta), pa.array(np.floor(theta / radius).astype(np.int32)), part.column("id"), part.column("vec")], names=["space", "pivot", "theta", "ring", "ord", "vec"])

        return vectors.select("space", "id", "vec").mapInArrow(place, TABLE)

    def _store(self, rows: DataFrame) -> None:
        order = ["space", "pivot", "theta"]
        part = self.scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order), "history")
        self.parts.append(part)
        self.rings.append(self.scratch.write(part.groupBy("space", "pivot", "ring").agg(F.count(F.lit(1)).alias("_rows")), "rings"))

    def append(self, vectors: DataFrame) -> None:
        """Stores (space, id as order, vec). Spaces without pivots are kept under pivot 0."""
        self._store(self._rows(vectors))

    def compact(self) -> None:
        """One table in the order of (space, pivot, theta) instead of a part for each batch."""
        old, self.parts, self.rings = [*self.parts, *self.rings], [], []
        self._store(union([p for p in old if "vec" in p.columns]))
        self.scratch.drop(*old)

    def reached(self, visits: DataFrame) -> DataFrame:
        """The part of the history that the pivots and angles of a batch's visits leave."""
        bounds = visits.groupBy("space", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("space", "pivot").collect()  # at most one row a pivot
        by_space: dict[str, list] = {}
        for r in bounds:
            by_space.setdefault(r.space, []).append(r)
        ok = F.lit(False)
        for space, mine in by_space.items():
            between = lambda lo, hi: (F.col("theta") >= lo * self.radius - 1e-6) & (F.col("theta") <= (hi + 1) * self.radius + 1e-6)
            if len(bounds) <= RANGES:
                for r in mine:
                    ok = ok | ((F.col("space") == space) & (F.col("pivot") == r.pivot) & between(r.lo, r.hi))
            else:
                ok = ok | ((F.col("space") == space) & F.col("pivot").isin([r.pivot for r in mine]) & between(min(r.lo for r in mine), max(r.hi for r in mine)))
        return self.history().filter(ok)

    def history(self) -> DataFrame:
        return union(self.parts)

    def visits(self, batch: DataFrame) -> DataFrame:
        """(space, pivot, lo, hi, theta, qid, vec): pivots and rings that may hold a match."""
        pivots, radius = batch.sparkSession.sparkContext.broadcast(self.pivots), self.radius
        chord = 2 * math.sin(radius / 2)

        def route(batches):
            for b in batches:
                for space, rows in spaces(b.column("space")):
                    part = b.take(pa.array(rows))
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    x, p = unit(unpack(part.column("vec"))), pivots.value.get(space)
                    if p is None:
                        theta, q, r = np.full((len(x), 1), math.pi / 2), np.arange(len(x)), np.zeros(len(x), np.int64)
                    else:
                        sims = x @ p.T
                        ok = np.ones(sims.shape, bool)
                        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                        near = np.argsort(-sims, axis=1)[:, :6]
                        for j in range(near.shape[1]):
                            other = near[:, j]
                            ok &= np.take_along_axis(sims, other[:, None], 1) - sims <= chord * apart[other] + 1e-5
                        theta = np.arccos(np.clip(sims.astype(np.float64), -1, 1))
                        q, r = np.nonzero(ok)
                    t = theta[q, r]
                    lo, hi = np.floor((t - radius) / radius - 1e-4).astype(np.int32), np.floor((t + radius) / radius + 1e-4).astype(np.int32)
                    for s in range(0, len(q), 20_000):
                        e = slice(s, s + 20_000)
                        yield pa.RecordBatch.from_arrays([pa.array([space] * len(q[e]), pa.string()), pa.array(r[e].astype(np.int32)), pa.array(lo[e]), pa.array(hi[e]), pa.array(t[e]), pa.array(ids[q[e]]), part.column("vec").take(pa.array(q[e]))], names=["space", "pivot", "lo", "hi", "theta", "qid", "vec"])

        return batch.mapInArrow(route, "space string, pivot int, lo int, hi int, theta double, qid bigint, vec binary")

    def repeats(self, batch: DataFrame) -> DataFrame:
        """Ids of (space, id, vec) with a vector of smaller order in the history, or in the batch
        itself, whose cosine is at least the bound. The batch isn't appended."""
        queries = self.scratch.write(batch.groupBy("space", "vec").agg(F.min("id").alias("id")), "queries")
        copies = batch.select("id").join(queries.select("id"), "id", "left_anti")
        own = self._rows(queries)
        visits = self.scratch.write(self.visits(queries), "visits")
        stored = own if not self.parts else self.reached(visits).unionByName(own)
        # rings of a pivot, in order, packed into slots of up to BUCKET rows: one small row a pivot
        counts = union([*self.rings, own.groupBy("space", "pivot", "ring").agg(F.count(F.lit(1)).alias("_rows"))]).groupBy("space", "pivot", "ring").agg(F.sum("_rows").alias("_rows"))
        met = visits.select("space", "pivot", "lo", "hi").distinct().select("space", "pivot", F.explode(F.sequence("lo", "hi")).alias("ring")).distinct()
        before = F.sum("_rows").over(W.partitionBy("space", "pivot").orderBy("ring")) - F.col("_rows")
        rings = counts.join(met, ["space", "pivot", "ring"], "left_semi").select("space", "pivot", "ring", F.floor(before / BUCKET).cast("int").alias("slot"), F.ceil(F.col("_rows") / BUCKET).cast("int").alias("salts"))
        rings = self.scratch.write(rings, "rings")
        bucket = ["space", "pivot", "slot", "salt"]
        salted = stored.join(rings, ["space", "pivot", "ring"]).withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("ord", "vec"), F.col("salts"))).otherwise(0).cast("int"))
        hist = salted.select(*bucket, "theta", "ord", "vec", F.lit(False).alias("query"))
        slots = rings.groupBy("space", "pivot").agg(F.collect_list(F.struct("ring", "slot", "salts")).alias("_r"))
        met = F.expr("array_distinct(flatten(transform(filter(_r, x -> x.ring between lo and hi), x -> transform(sequence(0, x.salts - 1), s -> struct(x.slot as slot, s as salt)))))")
        asked = visits.join(slots, ["space", "pivot"]).withColumn("_m", F.explode(met)).select("space", "pivot", "_m.slot", "_m.salt", "theta", F.col("qid").alias("ord"), "vec", F.lit(True).alias("query"))
        least, radius = self.least, self.radius

        def match(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            is_q = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
            order, theta = t.column("ord").to_numpy(), t.column("theta").to_numpy()
            q, h = np.flatnonzero(is_q), np.flatnonzero(~is_q)
            hit: list[np.ndarray] = []
            if len(q) and len(h):
                raw = unpack(t.column("vec"))
                q, h = q[np.argsort(theta[q], kind="stable")], h[np.argsort(theta[h], kind="stable")]
                xh, th = unit(raw[h]), theta[h]
                for s in range(0, len(q), 256):
                    part = q[s : s + 256]
                    lo, hi = np.searchsorted(th, theta[part[0]] - radius - 1e-4), np.searchsorted(th, theta[part[-1]] + radius + 1e-4)
                    a, b = np.nonzero(unit(raw[part]) @ xh[lo:hi].T >= least - 1e-5)
                    a, b = part[a], h[b + lo]
                    earlier = order[b] < order[a]
                    a, b = a[earlier], b[earlier]
                    if len(a):
                        cos = np.einsum("ij,ij->i", unit64(raw[a]), unit64(raw[b]))
                        hit.append(np.unique(order[a[cos >= least]]))
            return pa.table({"id": np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)})

        found = hist.unionByName(asked).groupBy(*bucket).applyInArrow(match, "id bigint")
        return found.unionByName(copies).distinct()


def vectors_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Points with order -1, and upserts with `seq` as order."""
    colls = spark.read.parquet(f"{sf}/collections.parquet")
    points = point_vectors(spark.read.parquet(f"{sf}/points.parquet"), colls).withColumn("id", F.lit(-1).cast("bigint"))
    return points, point_vectors(spark.read.parquet(f"{sf}/upserts.parquet"), colls, "seq")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """All batches at once: the order within and between them is that of `seq`."""
    points, upserts = vectors_of(spark, sf)
    history = PivotHistory.begin(points, Scratch(spark, "p5"))
    history.append(points)
    return history.repeats(upserts).select(F.col("id").alias("seq"))


def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and rows that repeat something accepted earlier, of each batch: batch by batch in the
    order of arrival, each against the history so far, to which it is then appended."""
    points, upserts = vectors_of(spark, sf)
    table = spark.read.parquet(f"{sf}/upserts.parquet")
    scratch = Scratch(spark, "p5")
    history = PivotHistory.begin(points, scratch)
    history.append(points)
    rows = scratch.write(upserts.join(table.select(F.col("seq").alias("id"), "batch_no").distinct(), "id"), "upserts", ("batch_no",))
    batches = [r.batch_no for r in table.groupBy("batch_no").agg(F.min("seq").alias("s")).orderBy("s").collect()]
    found = []
    for n in batches:
        batch = rows.filter(F.col("batch_no").eqNullSafe(F.lit(n))).select("space", "id", "vec")
        found.append(scratch.write(history.repeats(batch), "found"))
        history.append(batch)
    out = table.select("seq", "batch_no")
    every = union(found).select(F.col("id").alias("seq"), F.lit(1).alias("_repeat")) if found else out.limit(0).select("seq", F.lit(1).alias("_repeat"))
    return out.join(every, "seq", "left").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.count("_repeat").alias("repeats"))


P5_SQL = (
    f"with {usable_sql('upserts', 'seq', 'v')}, {usable_sql('points', 'uid', 'u')}, p as (select distinct space, v from u), "
    "r as (select distinct v.id from v where exists (select 1 from p where p.space = v.space and list_cosine_similarity(p.v, v.v) >= 0.99) or exists (select 1 from v w where w.space = v.space and w.id < v.id and list_cosine_similarity(w.v, v.v) >= 0.99)) "
)
SQL = {
    "p5_found": P5_SQL + "select id as seq from r",
    "p5_batches": P5_SQL + "select batch_no, count(*) as n, count(r.id) as repeats from upserts left join r on r.id = upserts.seq group by batch_no",
}
