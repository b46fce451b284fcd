"""Vectors as compact binary columns, and NumPy kernels that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEC_SCHEMA = "space string, id bigint, vec binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        arr = b.column(3)
        lens = np.where(arr.is_null().to_numpy(zero_copy_only=False), -1, np.diff(arr.offsets.to_numpy()))
        dim = b.column(2).fill_null(-2).to_numpy(zero_copy_only=False)
        start = arr.offsets.to_numpy()[:-1]
        flat = arr.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        space, ids = b.column(0), b.column(1)
        for d in np.unique(dim[(lens == dim) & (dim > 0)]):
            rows = np.flatnonzero((lens == d) & (dim == d))
            x = flat[start[rows][:, None] + np.arange(d)]
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            rows, x = rows[ok], np.ascontiguousarray(x[ok])
            if not len(rows):
                continue
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([space.take(take), ids.take(take), pack(x)], names=["space", "id", "vec"])


#: Powers of ten tried by `pack`, and the tag of vectors that are stored as they are.
_EXPONENTS, _PLAIN = (2, 3, 4, 5), 255


def pack(x: np.ndarray) -> pa.Array:
    """Vectors of float32 as binary values, without loss.

    Coordinates that were written with few decimals are stored as 16-bit integers and a power of
    ten (adaptive lossless floating point coding, one choice for each vector); a vector for which
    that isn't exact is stored as it is. Equal vectors have equal codes.
    """
    n, d = x.shape
    tag, left = np.full(n, _PLAIN, np.uint8), np.arange(n)
    code = np.zeros((n, d), np.int16)
    for e in _EXPONENTS:
        v = x[left].astype(np.float64)
        r = np.rint(v * 10**e)
        ok = ((np.abs(r) <= 32767) & ((r / 10**e).astype(np.float32) == x[left])).all(1)
        code[left[ok]], tag[left[ok]] = r[ok], e
        left = left[~ok]
        if not len(left):
            break
    short = tag != _PLAIN
    offsets = np.concatenate([[0], np.cumsum(np.where(short, 1 + 2 * d, 1 + 4 * d))])
    if short.all():
        flat = np.concatenate([tag[:, None], code.view(np.uint8).reshape(n, -1)], 1).ravel()
    else:
        flat = np.zeros(offsets[-1], np.uint8)
        flat[offsets[:-1]] = tag
        for rows, raw in ((np.flatnonzero(short), code), (np.flatnonzero(~short), x)):
            if len(rows):
                b = np.ascontiguousarray(raw[rows]).view(np.uint8).reshape(len(rows), -1)
                flat[(offsets[rows] + 1)[:, None] + np.arange(b.shape[1])] = b
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def unpack(arr: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The matrix behind `pack`ed vectors of one length."""
    if isinstance(arr, pa.ChunkedArray):
        chunks = [unpack(c) for c in arr.chunks if len(c)]
        return np.concatenate(chunks) if chunks else np.zeros((0, 0), np.float32)
    n = len(arr)
    if not n:
        return np.zeros((0, 0), np.float32)
    off = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_binary(arr.type) else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)
    tag, width = data[off[:-1]], np.diff(off)
    out = None
    for t in np.unique(tag):
        rows = np.flatnonzero(tag == t)
        w = int(width[rows[0]])
        b = data[off[0] : off[-1]].reshape(n, w)[:, 1:] if len(rows) == n else data[(off[rows] + 1)[:, None] + np.arange(w - 1)]
        b = np.ascontiguousarray(b)
        x = b.view(np.float32) if t == _PLAIN else (b.view(np.int16) / float(10 ** int(t))).astype(np.float32)
        if len(rows) == n:
            return x
        if out is None:
            out = np.zeros((n, x.shape[1]), np.float32)
        out[rows] = x
    return out


def unpack_list(values: list[bytes]) -> np.ndarray:
    return unpack(pa.array([bytes(v) for v in values], pa.binary()))


def to_binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow binary array, without a Python object for each row."""
    x = np.ascontiguousarray(x)
    n, width = len(x), x.shape[1] * x.itemsize if x.ndim == 2 else 0
    offsets = np.arange(n + 1, dtype=np.int64) * width
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(x)])
    return pa.array([r.tobytes() for r in x], pa.binary())


def from_binary(arr: pa.Array | pa.ChunkedArray, dtype=np.float32) -> np.ndarray:
    """Matrix of a binary array whose values all have one length."""
    if isinstance(arr, pa.ChunkedArray):
        chunks = [from_binary(c, dtype) for c in arr.chunks if len(c)]
        return np.concatenate(chunks) if chunks else np.zeros((0, 0), dtype)
    n = len(arr)
    if not n:
        return np.zeros((0, 0), dtype)
    kind = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(n, -1) if off[-1] > off[0] else np.zeros((n, 0), dtype)


def spaces(values: pa.Array) -> list[tuple[str, np.ndarray]]:
    """Rows of each distinct value of a string column."""
    enc = values.dictionary_encode() if not isinstance(values, pa.ChunkedArray) else values.combine_chunks().dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False)
    return [(name, np.flatnonzero(codes == i)) for i, name in enumerate(enc.dictionary.to_pylist())]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the length is taken in double precision."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / n[:, None]).astype(np.float32)


def unit64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(df: DataFrame, space: Column, id_col: str, vec_col: str, dim: Column) -> DataFrame:
    """(space, id, vec) of the rows whose vector takes part.

    A vector takes part if it isn't null, has `dim` elements, none of them null, NaN or infinite,
    and isn't all zero. Rows repeated verbatim count once. A null id is left out.
    """
    picked = df.select(space.alias("space"), F.col(id_col).cast("bigint").alias("id"), dim.cast("int").alias("dim"), F.col(vec_col).cast("array<float>").alias("v"))
    return picked.filter("space is not null and id is not null").mapInArrow(_pack, VEC_SCHEMA)


def point_vectors(points: DataFrame, collections: DataFrame, id_col: str = "uid") -> DataFrame:
    """Usable vectors of points; the space is the collection. `collections` is metadata of bounded
    size (one row a collection); it is broadcast by Spark only below its own size threshold."""
    dims = collections.select(F.col("name").alias("_name"), F.col("dim").alias("_dim")).dropDuplicates(["_name"])
    cols = [c for c in (id_col, "vector") if c != "collection"]
    joined = points.select("collection", *cols).join(dims, F.col("collection") == F.col("_name"))
    return usable(joined, F.col("collection"), id_col, "vector", F.col("_dim"))


def usable_sql(table: str, id_col: str, name: str) -> str:
    """The same as SQL: a named query with (id, space, v), v in double precision."""
    return (
        f"{name} as (select distinct {id_col} as id, t.collection as space, list_transform(vector, lambda x: x::double) as v from {table} t "
        "join (select distinct name, dim from collections) c on c.name = t.collection where len(vector) = dim "
        f"and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 and {id_col} is not null)"
    )


def top_k(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of at least the k largest entries of each row (few more, or ties).

    The k-th largest of chunk maxima bounds the k-th largest entry from below, so that one
    comparison leaves a few survivors a row and no full selection is needed.
    """
    n, m = sims.shape
    if m <= 4 * k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    width = max(1, m // (40 * k))
    chunks = m // width
    full = chunks * width
    peak = sims[:, :full].reshape(n, width, chunks).max(1) if width > 1 else sims  # a chunk's columns lie `chunks` apart
    bound = -np.partition(-peak, k - 1, axis=1)[:, k - 1]
    r, g = np.divmod(np.flatnonzero(peak >= bound[:, None]), chunks)
    if width == 1:
        return r, g
    at, j = np.nonzero(sims[r[:, None], g[:, None] + chunks * np.arange(width)] >= bound[r][:, None])
    tail, col = np.nonzero(sims[:, full:] >= bound[:, None])
    rows, cols = np.concatenate([r[at], tail]), np.concatenate([g[at] + chunks * j, col + full])
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order]


def best(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score down, id up) of each row, from candidates ordered by row.

    Returns row, column and score, ordered by row and rank. Scores are multiples of 1e-6 from -1 to 1.
    """
    size = np.bincount(rows, minlength=n)
    width = int(size.max(initial=0))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    last = np.iinfo(np.int64)
    key, who, col = np.full((n, width), 3_000_000, np.int32), np.full((n, width), last.max), np.zeros((n, width), np.int64)
    key[rows, place], who[rows, place], col[rows, place] = np.rint((1 - score) * 1e6), ids, cols
    order = np.argsort(who, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(key, order, 1), axis=1, kind="stable"), 1)[:, :k]
    key, col = np.take_along_axis(key, order, 1), np.take_along_axis(col, order, 1)
    r, c = np.nonzero(key < 3_000_000)
    return r, col[r, c], np.round(1 - key[r, c] / 1e6, 6)


def lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List array of `values`, which are ordered by row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
