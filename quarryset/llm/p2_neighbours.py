"""Most similar vectors for every vector: NN-descent in blocks, and greedy graph search.

Each record has a home cell (a partition by the nearest of sampled records) and a cell of a second,
independent partition. Both give exact neighbours within a cell by matrix products. A round of
NN-descent then follows every fresh edge that leaves a cell: (u, v) sends u to v's cell and v to
u's cell, so that u meets v's neighbours and v meets u's. This is the join of neighbours with
neighbours, done for whole cells at a time: a vector travels once to a cell however many of the
cell's records point at it. Rounds end when few entries change.

Vectors are shuffled to their home once and stored there, in buckets by cell; a round reads them in
place, and only visitors and better entries move. No cell is larger than twice `CELL`: what the
first partition leaves larger is split by records drawn from it, again and again.

A least cosine that the result asks for is pushed down into the lists: entries below it are neither
kept nor followed.

Exact copies (equal vectors) are one node of the graph, so that a third of all rows being copies
costs one node; they come back when pairs are written, eight at most for each record.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryset.llm.p1_clusters import _chance, nearest
from quarryset.llm.vectors import best, point_vectors, spaces, top_k, unit, unit64, unpack, unpack_list, usable_sql
from quarryset.runtime import Scratch, parts

#: Entries kept for each node; records aimed at for each cell, and for each of the seeds it is made
#: of; most seeds of one space (cells that grow beyond `CELL` for it are split where they lie).
KEEP, CELL, FINE, MOST_SEEDS = 10, 6000, 80, 8192
#: Most rounds, the trips (as a share of nodes) that are too few for another one, and how many of a
#: node's entries are followed in a round (the best of them, as NN-descent samples its neighbours).
ROUNDS, ENOUGH, FOLLOW = 8, 0.02, 6
#: Copies of a vector that one task expands.
SLICE = 100_000
#: Nodes of a space that a search may start from (sampled, broadcast).
ENTRIES = 4096
#: Homes are c0 * SPLIT + part; those of nodes with copies are stored as -1 - home.
SPLIT = 1 << 20
#: A list is one binary value of entries, best first: neighbour, its home, cosine in millionths, and
#: whether the entry is new. Spark moves it as it is, without a loop over elements.
ENTRY = np.dtype([("nbr", "<i8"), ("home", "<i8"), ("score", "<i4"), ("fresh", "i1")])
#: low: the score that a node's next entry must reach. h, h2: hashes of the vector.
GRAPH = "space string, c0 int, id bigint, home bigint, list binary"
CELLS = GRAPH + ", c1 int, low int, vec binary, h bigint, h2 bigint"
VISITORS = "space string, c0 int, cell bigint, id bigint, home bigint, low int, vec binary"
#: Better entries (`cell` is null) and visitors (`list` is null) in one table.
NEWS = GRAPH + ", cell bigint, low int, vec binary"


class Graph(NamedTuple):
    """`lists`: a list for each node (a distinct vector, named by the smallest id that has it), best
    first, at most `KEEP`, by cosine and then smaller id. `nodes`: (space, id, vec). `members`:
    (space, rep, id) of all ids of nodes with copies."""

    lists: DataFrame
    nodes: DataFrame
    members: DataFrame


def _entries(lists_: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and the number in each."""
    if isinstance(lists_, pa.ChunkedArray):
        lists_ = lists_.combine_chunks()
        if isinstance(lists_, pa.ChunkedArray):
            parts_ = [_entries(c) for c in lists_.chunks] or [(np.zeros(0, ENTRY), np.zeros(0, np.int64))]
            return tuple(np.concatenate(x) for x in zip(*parts_, strict=True))
    n = len(lists_)
    if not n:
        return np.zeros(0, ENTRY), np.zeros(0, np.int64)
    off = np.frombuffer(lists_.buffers()[1], np.int64 if pa.types.is_large_binary(lists_.type) else np.int32)[lists_.offset : lists_.offset + n + 1].astype(np.int64)
    data = lists_.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return flat.view(ENTRY), np.diff(off) // ENTRY.itemsize


def _lists(size: np.ndarray, nbr: np.ndarray, home: np.ndarray, score: np.ndarray, fresh: np.ndarray | int = 0) -> pa.Array:
    """Lists from entries that are ordered by row; `size` has the number of entries of each row."""
    e = np.empty(len(nbr), ENTRY)
    e["nbr"], e["home"], e["score"], e["fresh"] = nbr, home, score, fresh
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * ENTRY.itemsize
    if offsets[-1] >= 2**31:
        raise ValueError("a cell's lists exceed 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(e.view(np.uint8))])


def _cell(home: np.ndarray) -> np.ndarray:
    return np.where(home < 0, -1 - home, home)


def _sample(nodes: DataFrame, want: dict[str, int], counts: dict[str, int], salt: int) -> dict[str, np.ndarray]:
    """Uniform sample of `want` vectors of each space, which has `counts` of them: those whose
    content has the smallest hash, so that copies are one."""
    most = max(want.values())
    bound = {s: min(1.0, (2 * n + 50) / counts[s]) for s, n in want.items()}  # all but surely holds enough
    limits = F.create_map(*[F.lit(x) for s, f in bound.items() for x in (s, int(f * (1 << 40)))])
    w = W.partitionBy("space").orderBy("key", "vec")
    drawn = nodes.select("space", F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(1 << 40)).alias("key"), "vec").filter(F.col("key") <= limits[F.col("space")])
    got = drawn.distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).collect()
    out = {}
    for space, n in want.items():
        mine = sorted((r for r in got if r.space == space), key=lambda r: r._n)[:n]
        if mine:
            out[space] = unit(unpack_list([r.vec for r in mine]))
    return out


def blocks(seeds: np.ndarray, each: float, aim: int) -> np.ndarray:
    """Block of each seed. Seeds near each other share a block of about `aim` records; a dense
    spot with more records than that gets several blocks, each around one of its seeds."""
    sims = seeds @ seeds.T
    free, groups = np.ones(len(seeds), bool), []
    for i in np.argsort(-(sims >= 0.6).sum(1), kind="stable"):
        if free[i]:
            mine = np.flatnonzero(free & (sims[i] >= 0.6))
            mine = mine if free[i] and i in mine else np.append(mine, i)
            free[mine] = False
            groups.append(mine)
    out, block, filled = np.zeros(len(seeds), np.int32), 0, 0.0
    for mine in groups:
        size = len(mine) * each
        if size > 1.5 * aim:
            heads = mine[: math.ceil(size / aim)]
            block += filled > 0
            out[mine] = block + sims[np.ix_(mine, heads)].argmax(1)
            block, filled = block + len(heads), 0.0
        else:
            if filled and filled + size > aim:
                block, filled = block + 1, 0.0
            out[mine] = block
            filled += size
    return out


def _place(records: DataFrame, seeds: list[dict[str, np.ndarray]], counts: dict[str, int]) -> DataFrame:
    """(space, c0, c1, lo, hi, vec): cells of two independent partitions. Equal vectors of a batch
    become one row with their smallest and largest id, so that copies don't travel."""
    maps = [{s: (x, blocks(x, counts[s] / len(x), CELL)) for s, x in one.items()} for one in seeds]
    shared = records.sparkSession.sparkContext.broadcast(maps)

    def place(batches):
        for b in batches:
            for space, rows in spaces(b.column("space")):
                part = b.take(pa.array(rows))
                ids = part.column("id").to_numpy()
                at = part.column("vec").dictionary_encode().indices.to_numpy()
                order = np.lexsort((ids, at))
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                last = np.append(first[1:], len(order)) - 1
                vec = part.column("vec").take(pa.array(order[first]))
                x = unit(unpack(vec))
                c0, c1 = (pa.array(block[nearest(x, seed)[1]]) for seed, block in (m[space] for m in shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([space] * len(first), pa.string()), c0, c1, pa.array(ids[order[first]]), pa.array(ids[order[last]]), vec], names=["space", "c0", "c1", "lo", "hi", "vec"])

    return records.select("space", "id", "vec").mapInArrow(place, "space string, c0 int, c1 int, lo bigint, hi bigint, vec binary")


def _split(x: np.ndarray, ids: np.ndarray, aim: int, salt: int = 13) -> np.ndarray:
    """Part of each row, none of more than twice `aim` rows: rows go to the nearest of records
    drawn from them, and parts that stay too large are split again; what can't be told apart so
    (one direction at many lengths) is cut in the order of ids."""
    n, out = len(x), np.zeros(len(x), np.int64)
    if n <= 2 * aim:
        return out
    heads = np.argsort(_chance(ids, salt), kind="stable")[: math.ceil(n / aim)]
    at, base = nearest(x, x[heads])[1], 0
    if np.bincount(at).max() == n:
        out[np.argsort(ids, kind="stable")] = np.arange(n) // aim
        return out
    for j in np.unique(at):
        rows = np.flatnonzero(at == j)
        out[rows] = base + _split(x[rows], ids[rows], aim, salt + 1)
        base = int(out[rows].max()) + 1
    return out


def _true(mask: np.ndarray) -> np.ndarray:
    """As np.flatnonzero, for masks with few hits: eight entries are looked at at once."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    w, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[w] * 8 + bit, whole + np.flatnonzero(flat[whole:])])


def _hits(sims: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that reach their row's bound: all of them or, of rows with many, at least the k largest."""
    mask = sims >= bound[:, None]
    if np.count_nonzero(mask) <= 2 * k * len(sims):
        return np.divmod(_true(mask), sims.shape[1])
    r, c = top_k(sims, k)
    ok = sims[r, c] >= bound[r]
    return r[ok], c[ok]


def _mutual(x: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of rows whose product reaches one bound, both ways and ordered by row; only half of
    the products are taken. None if there are more than `k` a row, for which it isn't worth it."""
    some = x[:: max(1, len(x) // 128)]
    if np.count_nonzero(some @ x.T >= bound) > k * len(some):
        return None
    got, many = [], 0
    for s in range(0, len(x), 256):
        for f in range(s, len(x), 2048):  # a tile stays in the cache
            mask = x[s : s + 256] @ x[f : f + 2048].T >= bound
            n = np.count_nonzero(mask)
            if not n:
                continue
            many += n
            if many > k * len(x):
                return None
            r, c = np.divmod(_true(mask), mask.shape[1])
            r, c = r + s, c + f
            ok = c > r
            got.append(np.stack([r[ok], c[ok]]))
    r, c = np.concatenate(got, 1) if got else np.zeros((2, 0), np.int64)
    r, c = np.concatenate([r, c]), np.concatenate([c, r])
    order = np.argsort(r, kind="stable")
    return r[order], c[order]


def _bound(low: np.ndarray) -> np.ndarray:
    """Bounds on cosines in single precision that no score of at least `low` misses."""
    return ((low - 2) / 1e6).astype(np.float32)


def _exact(x64: np.ndarray, y64: np.ndarray, rows: np.ndarray, cols: np.ndarray, low: np.ndarray, yid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `KEEP` best of candidates ordered by row: (distinct rows, place in them, column, score).
    Rows and columns are those of x and y; `low` is a score for each row of x."""
    cos = np.concatenate([np.einsum("ij,ij->i", x64[rows[s : s + 200_000]], y64[cols[s : s + 200_000]]) for s in range(0, len(rows), 200_000)] or [np.zeros(0)])
    cos = np.round(cos, 6)
    ok = np.rint(cos * 1e6) >= low[rows]
    rows, cols, cos = rows[ok], cols[ok], cos[ok]
    have, at = np.unique(rows, return_inverse=True)
    r, c, cos = best(at, cols, cos, yid[cols], len(have), KEEP)
    return have, r, c, np.rint(cos * 1e6).astype(np.int32)


def _rows(space: str, ids: np.ndarray, homes: np.ndarray, r: np.ndarray, nbr: np.ndarray, score: np.ndarray, nhome: np.ndarray, fresh: np.ndarray | int = 0) -> pa.Table:
    """Nodes with their lists; r is the node's place, for each entry in order."""
    n = len(ids)
    return pa.table({"space": pa.array([space] * n, pa.string()), "c0": pa.array((_cell(homes) // SPLIT).astype(np.int32)), "id": ids, "home": homes, "list": _lists(np.bincount(r, minlength=n), nbr, nhome, score, fresh)})


def _settle(floor: int):
    """A home cell: its distinct vectors as nodes, each with its exact neighbours within its part."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        space, c0 = key[0].as_py(), key[1].as_py()
        at = t.column("vec").chunk(0).dictionary_encode().indices.to_numpy()
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        n = int(at.max()) + 1
        ids, last, row = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
        np.minimum.at(ids, at, lo), np.maximum.at(last, at, hi)
        row[at] = np.arange(len(at))
        order = np.argsort(ids, kind="stable")
        ids, last, row = ids[order], last[order], row[order]
        t = t.take(pa.array(row))
        raw = unpack(t.column("vec"))
        x, x64 = unit(raw), unit64(raw)
        home, got = np.zeros(n, np.int64), []
        parts_ = _split(x, ids, CELL)
        for part in np.unique(parts_):
            p = np.flatnonzero(parts_ == part)
            home[p] = part
            low, y = np.full(len(p), floor), x[p]
            bound = _bound(low)
            pairs = _mutual(y, bound[0], 4 * KEEP)
            if pairs is None:
                each, step = [], max(1, 1_000_000 // len(p))
                for s in range(0, len(p), step):
                    r, c = _hits(y[s : s + step] @ y.T, bound[s : s + step], KEEP + 1)
                    keep = r + s != c
                    each.append((r[keep] + s, c[keep]))
                pairs = tuple(np.concatenate(a) for a in zip(*each, strict=True))
            have, r, c, score = _exact(x64[p], x64[p], *pairs, low, ids[p])
            got.append((p[have[r]], p[c], score))
        home += c0 * SPLIT
        signed = np.where(last > ids, -1 - home, home)
        r, c, score = (np.concatenate(a) for a in zip(*got, strict=True))
        order = np.argsort(r, kind="stable")
        r, c, score = r[order], c[order], score[order]
        size = np.bincount(r, minlength=n)
        low = np.full(n, floor, np.int64)
        full = np.flatnonzero(size == KEEP)
        low[full] = score[np.cumsum(size)[full] - 1]
        out = _rows(space, ids, signed, r, ids[c], score, signed[c])
        for name, values in (("c1", t.column("c1")), ("low", pa.array(low.astype(np.int32))), ("vec", t.column("vec")), ("h", t.column("h")), ("h2", t.column("h2"))):
            out = out.append_column(name, values)
        return out.select([f.split()[0] for f in CELLS.split(", ")])

    return run


def _across(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A cell of the second partition: better entries between records of different home cells, and
    the trips along them, with both ends' vectors at hand."""
    space = key[0].as_py()
    ids, homes, low = (t.column(c).to_numpy() for c in ("id", "home", "low"))
    at = _cell(homes)
    raw = unpack(t.column("vec"))
    x, x64 = unit(raw), unit64(raw)
    part = _split(x, ids, CELL)
    out, trips = [_rows(space, ids[:0], homes[:0], ids[:0], ids[:0], low[:0], homes[:0])], [np.zeros((2, 0), np.int64)]
    for one in np.unique(part):
        p = np.flatnonzero(part == one)
        if (at[p] == at[p[0]]).all():
            continue
        bound, y = _bound(low[p]), x[p]
        pairs = _mutual(y, bound.min(), 8 * KEEP)
        if pairs is None:
            each, step = [], max(1, 1_000_000 // len(p))
            for s in range(0, len(p), step):
                # at most KEEP entries that reach the bound are of the same home
                r, c = _hits(y[s : s + step] @ y.T, bound[s : s + step], 2 * KEEP + 1)
                each.append((r + s, c))
            pairs = tuple(np.concatenate(a) for a in zip(*each, strict=True))
        r, c = pairs
        keep = at[p[r]] != at[p[c]]
        have, r, c, score = _exact(x64[p], x64[p], r[keep], c[keep], low[p], ids[p])
        out.append(_rows(space, ids[p[have]], homes[p[have]], r, ids[p[c]], score, homes[p[c]]))
        go = np.arange(len(r)) - np.searchsorted(r, r) < FOLLOW
        u, v = p[have[r[go]]], p[c[go]]
        trips.append(np.concatenate([np.stack([u, at[v]]), np.stack([v, at[u]])], 1))
    better = pa.concat_tables(out)
    who, to = np.unique(np.concatenate(trips, 1), axis=1)
    n, m = better.num_rows, len(who)
    go = t.take(pa.array(who))
    visitors = {"space": go.column("space"), "c0": pa.array((to // SPLIT).astype(np.int32)), "id": go.column("id"), "home": go.column("home"), "list": pa.nulls(m, pa.binary()), "cell": to, "low": go.column("low"), "vec": go.column("vec")}
    for name, kind in (("cell", pa.int64()), ("low", pa.int32()), ("vec", pa.binary())):
        better = better.append_column(name, pa.nulls(n, kind))
    return pa.concat_tables([better, pa.table(visitors).cast(better.schema)])


def _fetch(key: tuple[pa.Scalar, ...], t: pa.Table, asked: pa.Table) -> pa.Table:
    """The visitors that leave a cell, with their vectors; `asked` is (id, cell)."""
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    want, to = asked.column("id").to_numpy(), asked.column("cell").to_numpy()
    at = np.searchsorted(ids[order], want)
    at = order[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else np.zeros(0, np.int64)
    got = t.take(pa.array(at))
    return pa.table({"space": got.column("space"), "c0": pa.array((to // SPLIT).astype(np.int32)), "cell": to, "id": got.column("id"), "home": got.column("home"), "low": got.column("low"), "vec": got.column("vec")})


def _meet(key: tuple[pa.Scalar, ...], t: pa.Table, guests: pa.Table) -> pa.Table:
    """Records of a cell and its visitors: better entries for each side."""
    space = key[0].as_py()
    none = np.zeros(0, np.int64)
    out = [_rows(space, none, none, none, none, none.astype(np.int32), none)]
    if not t.num_rows or not guests.num_rows:
        return out[0]
    at, cells = _cell(t.column("home").to_numpy()), guests.column("cell").to_numpy()
    for cell in np.unique(cells):
        own = t.take(pa.array(np.flatnonzero(at == cell)))
        if not own.num_rows:
            continue
        xi, xh, xl = (own.column(c).to_numpy() for c in ("id", "home", "low"))
        x = unpack(own.column("vec"))
        x, x64 = unit(x), unit64(x)
        mine = []
        rows = np.flatnonzero(cells == cell)
        step = max(1, 1_000_000 // len(x))
        for s in range(0, len(rows), 20_000):
            vis = guests.take(pa.array(rows[s : s + 20_000]))
            yi, yh, yl = (vis.column(c).to_numpy() for c in ("id", "home", "low"))
            y = unpack(vis.column("vec"))
            y, y64 = unit(y), unit64(y)
            theirs = []
            for f in range(0, len(y), step):
                sims = y[f : f + step] @ x.T
                r, c = _hits(sims, _bound(yl[f : f + step]), KEEP)
                theirs.append((r + f, c))
                mask = sims >= _bound(xl)
                if np.count_nonzero(mask) <= 2 * KEEP * len(x):
                    c, r = np.divmod(_true(mask), len(x))
                    order = np.argsort(r, kind="stable")
                    r, c = r[order], c[order]
                else:
                    r, c = _hits(np.ascontiguousarray(sims.T), _bound(xl), KEEP)
                have, r, c, score = _exact(x64, y64, r, c + f, xl, yi)
                mine.append((have[r], yi[c], score, yh[c]))
            r, c = (np.concatenate(a) for a in zip(*theirs, strict=True))
            have, r, c, score = _exact(y64, x64, r, c, yl, xi)
            out.append(_rows(space, yi[have], yh[have], r, xi[c], score, xh[c]))
        r, nbr, score, nhome = (np.concatenate(a) for a in zip(*mine, strict=True))
        order = np.lexsort((nbr, -score, r))
        r, nbr, score, nhome = r[order], nbr[order], score[order], nhome[order]
        have, at_row = np.unique(r, return_inverse=True)
        rank = np.arange(len(r)) - np.searchsorted(at_row, np.arange(len(have)))[at_row]
        ok = rank < KEEP
        out.append(_rows(space, xi[have], xh[have], at_row[ok], nbr[ok], score[ok], nhome[ok]))
    return pa.concat_tables(out)


def _merge(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
    """One list for each node of a cell from its old list and new ones; new entries are marked."""
    space = key[0].as_py()
    (e, many), (f, more) = _entries(old.column("list")), _entries(new.column("list"))
    if not new.num_rows:
        if not e["fresh"].any():
            return old
        return old.set_column(4, "list", _lists(many, e["nbr"], e["home"], e["score"]))
    oid, nid = old.column("id").to_numpy(), new.column("id").to_numpy()
    order = np.argsort(oid, kind="stable")
    to = order[np.searchsorted(oid[order], nid)]  # every node is in the old table
    hot = np.zeros(len(oid), bool)
    hot[to] = True
    r = np.concatenate([np.repeat(np.arange(len(oid)), many), np.repeat(to, more)])
    age = np.repeat([0, 1], [len(e), len(f)])
    every = np.concatenate([e, f])
    mix = hot[r]
    # lists with news: by row, cosine, id; of two equal entries the old one comes first
    m = np.flatnonzero(mix)
    m = m[np.lexsort((age[m], every["nbr"][m], -every["score"][m], r[m]))]
    same = np.zeros(len(m), bool)
    same[1:] = (r[m][1:] == r[m][:-1]) & (every["nbr"][m][1:] == every["nbr"][m][:-1])
    m = m[~same]
    rank = np.arange(len(m)) - np.searchsorted(r[m], r[m])
    m = m[rank < KEEP]
    rest = np.flatnonzero(~mix)
    pick = np.concatenate([rest, m])
    pick = pick[np.argsort(r[pick], kind="stable")]
    got = every[pick]
    return old.set_column(4, "list", _lists(np.bincount(r[pick], minlength=len(oid)), got["nbr"], got["home"], got["score"], age[pick]))


def _cross(batches):
    """(space, c0, id, cell): along new entries that leave a cell, both ends go to the other's cell."""
    for b in batches:
        e, size = _entries(b.column(b.schema.get_field_index("list")))
        row = np.repeat(np.arange(b.num_rows), size)
        u, hu = b.column(b.schema.get_field_index("id")).to_numpy()[row], _cell(b.column(b.schema.get_field_index("home")).to_numpy())[row]
        v, hv = e["nbr"], _cell(e["home"])
        rank = np.arange(len(u)) - np.repeat(np.cumsum(size) - size, size)
        go = (e["fresh"] > 0) & (hu != hv) & (rank < FOLLOW)
        for space, rows in spaces(b.column(b.schema.get_field_index("space"))):
            mine = np.zeros(b.num_rows, bool)
            mine[rows] = True
            i = np.flatnonzero(go & mine[row])
            trips = np.stack([np.concatenate([hu[i], hv[i]]), np.concatenate([u[i], v[i]]), np.concatenate([hv[i], hu[i]])], 1)
            trips = np.unique(trips, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([space] * len(trips), pa.string()), pa.array((trips[:, 0] // SPLIT).astype(np.int32)), pa.array(trips[:, 1]), pa.array(trips[:, 2])], names=["space", "c0", "id", "cell"])


def build(vectors: DataFrame, scratch: Scratch, least: float | None = None) -> Graph:
    """The neighbour graph of (space, id, vec), with entries of at least `least` only if given.

    Empty input gives empty tables.
    """
    spark = vectors.sparkSession
    records = scratch.write(vectors, "records")
    counts = {r.space: r["count"] for r in records.groupBy("space").count().collect()}
    total = sum(counts.values())
    if not total:
        return Graph(spark.createDataFrame([], GRAPH), records.select("space", "id", "vec"), spark.createDataFrame([], "space string, rep bigint, id bigint"))
    floor = -2_000_000 if least is None else math.floor(least * 1e6 + 0.5)
    want = {s: 2 * min(MOST_SEEDS, math.ceil(n / FINE)) for s, n in counts.items()}
    drawn = _sample(records, want, counts, 11)
    seeds = [{s: x[i::2] if len(x) > 1 else x for s, x in drawn.items()} for i in (0, 1)]
    buckets = parts(spark, total, 25_000)
    cell = ["space", "c0"]
    prints = [F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    placed = _place(records, seeds, counts).select("*", *prints).repartition(buckets, *cell)
    cells = scratch.write_bucketed(placed.groupBy(*cell).applyInArrow(_settle(floor), CELLS), "cells", buckets, *cell)
    twins = cells.filter("home < 0").select("space", F.col("id").alias("rep"), "h", "h2")
    members = scratch.write(records.select("space", "id", *prints).join(twins, ["space", "h", "h2"]).select("space", "rep", "id").distinct(), "members")
    scratch.drop(records)
    second = cells.select("space", "c1", "id", "home", "low", "vec")
    found = scratch.write(second.groupBy("space", "c1").applyInArrow(_across, NEWS), "news")
    columns = [f.split()[0] for f in GRAPH.split(", ")]
    graph, homes = cells.select(*columns), cells.select(*cell, "id", "home", "low", "vec")
    news, guests = found.filter("cell is null").select(*columns), found.filter("cell is not null").select("space", "c0", "cell", "id", "home", "low", "vec")
    seen = guests.select("space", F.expr(f"cast(floor(if(home < 0, -1 - home, home) / {SPLIT}) as int)").alias("c0"), "id", "cell")
    trips = guests.count()
    for step in range(ROUNDS):
        met = scratch.write(homes.groupBy(*cell).cogroup(guests.groupBy(*cell)).applyInArrow(_meet, GRAPH), "news") if trips else news.limit(0)
        merged = graph.groupBy(*cell).cogroup(news.unionByName(met).groupBy(*cell)).applyInArrow(_merge, GRAPH)
        better = scratch.write_bucketed(merged, "graph", buckets, *cell)
        scratch.drop(met, graph)
        graph, news = better, found.limit(0).select(*columns)
        if not trips or step + 1 == ROUNDS:
            break
        visits = graph.mapInArrow(_cross, "space string, c0 int, id bigint, cell bigint").distinct()
        visits = scratch.write(visits.join(seen, ["space", "c0", "id", "cell"], "left_anti"), "visits")
        trips = visits.count()
        if trips < ENOUGH * total:
            break
        seen = seen.unionByName(visits)
        guests = homes.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(_fetch, VISITORS)
    return Graph(graph, cells.select("space", "id", "vec"), members)


def _heads(members: DataFrame, k: int) -> DataFrame:
    """(space, rep, head): the k + 1 smallest ids of each node with copies, so that k are left
    for a record that is one of them."""
    w = W.partitionBy("space", "rep").orderBy("id")
    return members.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1).select("space", "rep", F.col("id").alias("head"))


def _edges(batches):
    """(space, id, home, at, nbr, cosine, single): the entries of lists; a list is single if neither
    its node nor a neighbour has copies."""
    for b in batches:
        e, size = _entries(b.column(b.schema.get_field_index("list")))
        row = np.repeat(np.arange(b.num_rows), size)
        home = b.column(b.schema.get_field_index("home")).to_numpy()
        single = home >= 0
        single[row[e["home"] < 0]] = False
        at = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("space")).take(take), b.column(b.schema.get_field_index("id")).take(take), pa.array(home[row]), pa.array(at.astype(np.int32)), pa.array(e["nbr"].copy()), pa.array(e["score"] / 1e6), pa.array(single[row])], names=["space", "id", "home", "at", "nbr", "cosine", "single"])


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select("space", "id", "home", "list").mapInArrow(_edges, "space string, id bigint, home bigint, at int, nbr bigint, cosine double, single boolean")


def neighbours(graph: DataFrame, members: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(space, id, nbr, cosine): up to k most similar other records of each record.

    Cosines are rounded to 6 places; of equal ones the smaller id comes first. Copies of a vector
    are each other's neighbours with cosine 1.
    """
    every = edges_of(graph).filter(F.col("cosine") >= least)
    plain = every.filter((F.col("at") < k) & F.col("single")).select("space", "id", "nbr", "cosine")
    heads = _heads(members, k)
    edges = every.filter("not single").select("space", "id", "home", F.col("nbr").alias("rep"), "cosine")
    wide = edges.join(heads, ["space", "rep"], "left").select("space", "id", "home", F.coalesce("head", "rep").alias("nbr"), "cosine")
    alone = wide.filter("home >= 0").select("space", "id", "nbr", "cosine")
    own = heads.select("space", F.col("rep").alias("id"), F.col("head").alias("nbr"), F.lit(1.0).alias("cosine"))
    # a vector may have very many copies: its few candidates go to each of as many slices as these need
    salts = members.groupBy("space", "rep").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_salts"))
    cand = wide.filter("home < 0").select("space", "id", "nbr", "cosine").unionByName(own).withColumnRenamed("id", "rep").join(salts, ["space", "rep"]).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    large = salts.filter("_salts > 1")  # at most one row for SLICE rows of members
    slices = members.join(large, ["space", "rep"], "left").withColumn("_s", F.pmod(F.xxhash64("id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = slices.join(cand, ["space", "rep", "_s"]).filter("id <> nbr").select("space", "id", "nbr", "cosine")
    w = W.partitionBy("space", "id").orderBy(F.desc("cosine"), "nbr")
    rest = alone.unionByName(copies).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    return plain.unionByName(rest).filter(F.col("cosine") >= least)


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, scratch: Scratch, k: int, beam: int = 64, width: int = 16, hops: int = 32, members: DataFrame | None = None) -> DataFrame:
    """(space, qid, id, cosine): greedy search of the graph for queries (space, qid, vec).

    All queries advance together. A query starts at the nearest of a bounded sample of nodes and
    keeps a beam; each hop joins the beam's best unexpanded nodes with their lists, scores the
    neighbours it hasn't met, and keeps the best. The search ends when no query's beam has a node
    left to expand (`hops` only guards against endless input). `nodes` is (space, id, vec) with the
    ids of the graph. With `members`, each node found stands for all ids that have its vector, as in
    `neighbours`; without, for the smallest of them only. A query's own id is left out. Queries in
    spaces without nodes find nothing. Cosines are rounded to 6 places.
    """
    counts = {r.space: r["count"] for r in nodes.groupBy("space").count().collect()}
    if not counts:
        return queries.select("space", "qid", F.col("qid").alias("id"), F.lit(0.0).alias("cosine")).limit(0)
    share = {s: min(1.0, ENTRIES / n) for s, n in counts.items()}
    most = F.create_map(*[F.lit(x) for s, f in share.items() for x in (s, int(f * 2**31))])
    entry = nodes.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2**31)) <= most[F.col("space")]).select("space", "id", "vec").collect()
    starts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for space in counts:
        mine = sorted((r for r in entry if r.space == space), key=lambda r: r.id)
        if mine:
            raw = unpack_list([r.vec for r in mine])
            starts[space] = np.array([r.id for r in mine]), unit(raw), unit64(raw)
    shared = queries.sparkSession.sparkContext.broadcast(starts)
    schema = "space string, qid bigint, id bigint, cosine double"

    def begin(batches):
        for b in batches:
            for space, rows in spaces(b.column("space")):
                if space not in shared.value:
                    continue
                ids, seeds, seeds64 = shared.value[space]
                n = min(beam, len(ids))
                for s in range(0, len(rows), 1000):
                    part = b.take(pa.array(rows[s : s + 1000]))
                    raw = unpack(part.column("vec"))
                    at = np.argpartition(-(unit(raw) @ seeds.T), n - 1, axis=1)[:, :n]
                    cos = np.einsum("ij,ikj->ik", unit64(raw), seeds64[at])
                    q = np.repeat(part.column("qid").to_numpy(), n)
                    yield pa.RecordBatch.from_arrays([pa.array([space] * len(q), pa.string()), pa.array(q), pa.array(ids[at].ravel()), pa.array(np.round(cos, 6).ravel())], names=["space", "qid", "id", "cosine"])

    def score(batches):
        for b in batches:
            for space, rows in spaces(b.column("space")):
                part = b.take(pa.array(rows))
                cos = np.einsum("ij,ij->i", unit64(unpack(part.column("vec"))), unit64(unpack(part.column("qvec"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("space", "qid", "id")), pa.array(np.round(cos, 6))], names=["space", "qid", "id", "cosine"])

    best_first = W.partitionBy("space", "qid").orderBy(F.desc("cosine"), "id")
    state = scratch.write(queries.mapInArrow(begin, schema).withColumn("done", F.lit(False)), "beam")
    # lists and vectors stay where they are, in buckets by id: a hop moves beams only
    buckets = parts(graph.sparkSession, sum(counts.values()), 25_000)
    links = scratch.write_bucketed(graph.select("space", "id", "home", "list").repartition(buckets, "id"), "links", buckets, "id")
    stored = scratch.write_bucketed(nodes.select("space", "id", "vec").repartition(buckets, "id"), "stored", buckets, "id")
    asked = queries.select("space", "qid", F.col("vec").alias("qvec"))
    for _ in range(hops):
        front = scratch.write(state.filter("not done").withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= width).select("space", "qid", "id"), "front")
        if front.isEmpty():
            break
        reached = links.select(F.col("space").alias("_s"), F.col("id").alias("_i"), "home", "list").join(front, F.col("_i") == F.col("id")).filter("_s = space").select("space", F.col("qid").alias("id"), "home", "list")
        met = edges_of(reached).select("space", F.col("id").alias("qid"), F.col("nbr").alias("id")).distinct().join(state.select("space", "qid", "id"), ["space", "qid", "id"], "left_anti")
        new = stored.select(F.col("space").alias("_s"), F.col("id").alias("_i"), "vec").join(met, F.col("_i") == F.col("id")).filter("_s = space").select("space", "id", "vec", "qid").join(asked, ["space", "qid"]).mapInArrow(score, schema).withColumn("done", F.lit(False))
        old = state.join(front.withColumn("_f", F.lit(True)), ["space", "qid", "id"], "left").select("space", "qid", "id", "cosine", F.coalesce(F.col("_f") | F.col("done"), F.col("done")).alias("done"))
        better = old.unionByName(new).withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= beam).drop("_n")
        state, before = scratch.write(better, "beam"), state
        scratch.drop(before, front)
    found = state.select("space", "qid", "id", "cosine")
    if members is not None:
        # k + 1 nodes have at least k ids besides the query's own, all before those of later nodes
        near = found.withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= k + 1).withColumnRenamed("id", "rep")
        found = near.join(_heads(members, k), ["space", "rep"], "left").select("space", "qid", F.coalesce("head", "rep").alias("id"), "cosine")
    return found.filter("id <> qid").withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= k).select("space", "qid", "id", "cosine")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return point_vectors(spark.read.parquet(f"{sf}/points.parquet"), spark.read.parquet(f"{sf}/collections.parquet"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    least = 0.86
    graph = build(_points(spark, sf), Scratch(spark, "p2"), least)
    near = neighbours(graph.lists, graph.members, 8, least)
    return near.select(F.least("id", "nbr").alias("uid_lo"), F.greatest("id", "nbr").alias("uid_hi")).distinct()


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(collection, uid, rank, neighbour, cosine) for every point with a usable vector."""
    graph = build(_points(spark, sf), Scratch(spark, "p2"))
    near = neighbours(graph.lists, graph.members, 8)
    w = W.partitionBy("space", "id").orderBy(F.desc("cosine"), "nbr")
    return near.distinct().select(F.col("space").alias("collection"), F.col("id").alias("uid"), F.row_number().over(w).cast("bigint").alias("rank"), F.col("nbr").alias("neighbour"), "cosine")


def p2_search(spark: SparkSession, sf: str) -> DataFrame:
    """Queries (every point whose uid is divisible by 20) against all points, by greedy search."""
    scratch = Scratch(spark, "p2")
    points = scratch.write(_points(spark, sf).distinct(), "points")
    graph = build(points, scratch)
    found = search(graph.lists, graph.nodes, points.filter("id % 20 = 0").select("space", F.col("id").alias("qid"), "vec"), scratch, 8, members=graph.members)
    return found.select(F.col("space").alias("collection"), "qid", F.col("id").alias("uid"), "cosine")


_NEAR = (
    f"with {usable_sql('points', 'uid', 'v')}, s as (select a.space, a.id, b.id as nbr, round(list_cosine_similarity(a.v, b.v), 6) as cosine from v a join v b on a.space = b.space and a.id <> b.id), "
    "r as (select *, row_number() over (partition by space, id order by cosine desc, nbr) as rank from s) "
)
SQL = {
    "p2_found": _NEAR + "select distinct least(id, nbr) as uid_lo, greatest(id, nbr) as uid_hi from r where rank <= 8 and cosine >= 0.86",
    "p2_neighbours": _NEAR + "select space as collection, id as uid, rank, nbr as neighbour, cosine from r where rank <= 8",
}
