"""Codecs for vectors: scalar, half precision and product quantization."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sq8_train(points: DataFrame, vector: str = "vector") -> DataFrame:
    """(lo, hi): least and greatest value of each dimension, as two arrays in one row.

    Folded per dimension by partial aggregation: what is shuffled has the size of one vector a task.
    """
    dims = points.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = F.array_sort(F.collect_list(F.struct("i", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))))
    return dims.agg(s.alias("s")).select(F.expr("transform(s, x -> x.lo)").alias("lo"), F.expr("transform(s, x -> x.hi)").alias("hi"))


def sq8_encode(points: DataFrame, ranges: DataFrame, vector: str = "vector", levels: int = 254) -> DataFrame:
    """Adds `codes`: (x - middle) / (range / levels), rounded and clamped. 14 levels give 4 bits."""
    half = levels // 2
    code = f"transform(arrays_zip(cast({vector} as array<double>), lo, hi), z -> cast(greatest(-{half}D, least({half}D, case when z.hi > z.lo then round((z.`0` - (z.lo + z.hi) / 2) / ((z.hi - z.lo) / {levels}D)) else 0D end)) as int))"
    code = code.replace("z.`0`", "z['0']")
    return points.crossJoin(F.broadcast(ranges)).withColumn("codes", F.expr(code)).drop("lo", "hi")


def sq8_decode(coded: DataFrame, ranges: DataFrame, levels: int = 254) -> DataFrame:
    """Adds `decoded`, the vectors behind the codes."""
    value = f"transform(arrays_zip(codes, lo, hi), z -> (z.lo + z.hi) / 2 + z.codes * ((z.hi - z.lo) / {levels}D))"
    return coded.crossJoin(F.broadcast(ranges)).withColumn("decoded", F.expr(value)).drop("lo", "hi")


def sq8_blocks(patches: DataFrame, block: int = 32) -> DataFrame:
    """(doc_id, patch_no, codes, scale): vectors of a block share their largest absolute value as
    scale, kept in half precision."""
    half = F.pandas_udf(lambda s: s.astype(np.float16).astype(np.float64), "double")
    b = patches.withColumn("_b", F.floor(F.col("patch_no") / block))
    peak = F.aggregate(F.transform("vector", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: F.greatest(a, x))
    scales = b.groupBy("doc_id", "_b").agg(F.max(peak).alias("_m")).select("doc_id", "_b", half("_m").alias("scale"))
    code = F.expr("transform(vector, x -> cast(case when scale > 0 then greatest(-127D, least(127D, round(x / scale * 127D))) else 0D end as int))")
    return b.join(scales, ["doc_id", "_b"]).select("doc_id", "patch_no", code.alias("codes"), "scale")


def fp16(vector: Column) -> Column:
    """A vector after a round trip through half precision, a whole batch at once."""

    @F.arrow_udf("array<float>")
    def trip(v: pa.Array) -> pa.Array:
        flat = v.values.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        return pa.ListArray.from_arrays(v.offsets, pa.array(flat), mask=v.is_null() if v.null_count else None)

    return trip(vector)


def sq8_distance(coded: DataFrame, ranges: DataFrame, query: list[float], metric: str = "l2", levels: int = 254) -> DataFrame:
    """(id, score) of coded vectors (id, codes) to a query, without decoding them first.

    With x = mid + step * code per dimension, the dot product is dot(mid, q) + sum(code * (step * q)),
    so the query is scaled once and codes are multiplied as they are; the squared distance follows
    the same way.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    plan = ranges.select(F.expr("transform(arrays_zip(lo, hi), z -> (z.lo + z.hi) / 2)").alias("_mid"), F.expr(f"transform(arrays_zip(lo, hi), z -> (z.hi - z.lo) / {levels}D)").alias("_step"))
    if metric == "dot":
        plan = plan.select(fold(F.zip_with("_mid", q, lambda m, x: m * x)).alias("_base"), F.zip_with("_step", q, lambda w, x: w * x).alias("_scaled"))
        score = F.col("_base") + fold(F.zip_with("codes", "_scaled", lambda c, x: c * x))
    else:
        plan = plan.select(F.zip_with(q, "_mid", lambda x, m: x - m).alias("_off"), "_step")
        score = F.sqrt(fold(F.zip_with(F.zip_with("codes", "_step", lambda c, w: c * w), "_off", lambda x, o: (x - o) * (x - o))))
    return coded.crossJoin(F.broadcast(plan)).select("id", F.round(score, 6).alias("score"))  # one row


def _book(codebook: DataFrame, m: int) -> list[np.ndarray]:
    """Centroids of each slice in the order of codes: at most m x 2^nbits rows, collected."""
    rows = codebook.select("sub", "code", F.col("centroid").cast("array<double>").alias("centroid")).orderBy("sub", "code").collect()
    return [np.array([r.centroid for r in rows if r["sub"] == s], np.float64) for s in range(m)]


def pq_assign(points: DataFrame, codebook: DataFrame, m: int, dim: int, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """(id, codes): nearest centroid of each of m slices; ties take the smaller code.

    `codebook` is (sub, code, centroid) with codes from 0 without gaps, of at most m x 2^nbits rows
    (64k for 256 slices of 8 bits). One matrix product a slice and batch; no shuffle. Vectors of
    another length have no row.
    """
    book, width = _book(codebook, m), dim // m
    shared = points.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            v = b.column(1)
            if not b.num_rows:
                continue
            off = v.offsets.to_numpy()
            x = v.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(b.num_rows, dim)
            codes = np.zeros((b.num_rows, m), np.int32)
            for s, c in enumerate(shared.value):
                part = x[:, s * width : (s + 1) * width]
                d = np.round(((part[:, None, :] - c[None]) ** 2).sum(2), 9) if len(c) * width <= 4096 else np.round((part * part).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * part @ c.T, 9)
                codes[:, s] = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), m).cast(pa.list_(pa.int32()))], names=["id", "codes"])

    rows = points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, codes array<int>")


def pq_decode(coded: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds `decoded`: the centroids behind the codes, one after the other."""
    book = codebook.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", F.col("centroid").cast("array<double>").alias("c")))), lambda x: x["c"]).alias("cs"))
    one = book.agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "cs"))), lambda x: x["cs"]).alias("_book"))  # the codebook as one row
    return coded.crossJoin(F.broadcast(one)).withColumn("decoded", F.flatten(F.zip_with("codes", "_book", lambda c, cs: F.get(cs, c)))).drop("_book")


def pq_table(codebook: DataFrame, query: list[float], m: int) -> DataFrame:
    """(sub, code, d): squared distance of each slice of a query to each centroid."""
    width = len(query) // m
    parts = F.array(*[F.array(*[F.lit(float(x)) for x in query[s * width : (s + 1) * width]]) for s in range(m)])
    d = F.aggregate(F.zip_with(parts[F.col("sub")], F.col("centroid").cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return codebook.select("sub", "code", d.alias("d"))


def pq_search(coded: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(id, score): squared distances added up from the table of the query, nearest first. The table
    has one row for each centroid; it goes to every row as one nested array."""
    subs = table.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d"))), lambda x: x["d"]).alias("ds"))
    one = subs.agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "ds"))), lambda x: x["ds"]).alias("_t"))
    score = F.aggregate(F.zip_with("codes", "_t", lambda c, ds: F.get(ds, c)), F.lit(0.0), lambda a, x: a + x)
    return coded.crossJoin(F.broadcast(one)).select("id", F.round(score, 6).alias("score")).orderBy("score", "id").limit(k)


def pq_train(points: DataFrame, m: int, k: int, dim: int, rounds: int = 10, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """(sub, code, centroid) by Lloyd rounds; the first k ids give the first centroids (k = 2^nbits).

    Each task adds up its vectors by code before anything moves: a round shuffles m x k sums a task,
    and the codebook is the only thing collected.
    """
    spark, width = points.sparkSession, dim // m
    rows = points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    first = rows.orderBy("id").limit(k).collect()
    book = [np.array([r.v[s * width : (s + 1) * width] for r in first], np.float64) for s in range(m)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)

        def add(batches, shared=shared):
            total = [np.zeros((len(c), width + 1)) for c in shared.value]
            for b in batches:
                v = b.column(0)
                off = v.offsets.to_numpy()
                x = v.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(b.num_rows, dim)
                for s, c in enumerate(shared.value):
                    part = x[:, s * width : (s + 1) * width]
                    d = np.round((part * part).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * part @ c.T, 9)
                    np.add.at(total[s], d.argmin(1), np.concatenate([part, np.ones((len(part), 1))], 1))
            for s, t in enumerate(total):
                hit = np.flatnonzero(t[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), s, np.int32)), pa.array(hit.astype(np.int32)), pa.array(t[hit].tolist(), pa.list_(pa.float64()))], names=["sub", "code", "t"])

        sums = rows.select("v").mapInArrow(add, "sub int, code int, t array<double>").select("sub", "code", F.posexplode("t").alias("i", "x"))
        means = sums.groupBy("sub", "code", "i").agg(F.sum("x").alias("x")).groupBy("sub", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("t")).collect()
        shared.unpersist()
        book = [c.copy() for c in book]
        for r in means:
            book[r["sub"]][r.code] = np.array(r.t[:-1]) / r.t[-1]
    return spark.createDataFrame([(s, c, [float(x) for x in v]) for s, part in enumerate(book) for c, v in enumerate(part)], "sub int, code int, centroid array<double>")
