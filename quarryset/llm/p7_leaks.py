"""Evaluation texts leaking into training text: q-gram lemma filtering and banded alignment.

A passage's windows of `words` words are what must not occur. If a text holds a window of length m
with at most e edits, the two share at least m + 1 - q (e + 1) character q-grams, and those lie
in one diagonal band. So, for each batch of documents at once:

1. Texts are normalised (`normalise`) and all their q-grams hashed by doubling, in NumPy.
2. q-grams that occur in no passage fall to a bitmap, the rest are looked up exactly.
3. Hits are counted per (document, passage, diagonal band); bands overlap by half, so that no
   region is split between two. A window survives if its own hits reach the lemma's bound.
4. Survivors are verified by edit distance within the band, all at once.

The passages are a stated query set: they are taken in blocks of bounded size, each broadcast and
run against all documents. Equal passages are one. The corpus is never shuffled.
"""

from __future__ import annotations

import html
import math
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of q-grams, words of a window, edits allowed in it, characters of passages in a block.
Q, WORDS, EDITS, BLOCK = 12, 12, 2, 8_000_000
_MARKS = regex.compile(r"[\p{M}\p{Cf}\p{Cs}]+")
_GAPS = regex.compile(r"[^\p{L}\p{N}\x1e]+")
# Letters that carry a stroke instead of an accent, and their plain forms.
_STROKES = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        text = _MARKS.sub("", text)
        for stroked, plain in _STROKES.items():
            text = text.replace(stroked, plain)
        return text
    return text.lower()


def normalise(text: str | None) -> str:
    """Words (runs of letters and digits), separated by one space.

    Entities are resolved, case, accents, signs, line breaks and invisible characters don't
    matter. Null gives an empty string.
    """
    return _GAPS.sub(" ", _plain((text or "").replace("\x1e", " "))).strip()


def normalise_all(texts: list[str | None]) -> list[str]:
    """`normalise` for many texts, in runs of about a million characters."""
    out: list[str] = []
    run: list[str] = []
    size = 0
    for t in [*texts, None]:
        if len(out) + len(run) < len(texts):
            run.append((t or "").replace("\x1e", " "))
            size += len(run[-1])
        if run and (size > 1_000_000 or len(out) + len(run) == len(texts)):
            # an entity that stands unfinished at the end of a text must not run into the next
            joined = " \x1e ".join(run)
            parts = _GAPS.sub(" ", _plain(joined)).split("\x1e")
            out += [p.strip() for p in parts] if len(parts) == len(run) else [normalise(r) for r in run]
            run, size = [], 0
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram of a text, from hashes of its halves."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        level, width, done, out = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, 0, None
        n = len(codes) - q + 1
        while True:
            if q & width:
                part = level[done : done + n]
                out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
                done += width
            if done == q:
                return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            level = (level[:-width] ^ (level[:-width] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + level[width:]
            width *= 2


class Passages:
    """Index of a block of normalised passages: {text: item ids}."""

    def __init__(self, texts: dict[str, list[int]], q: int = Q, words: int = WORDS, edits: int = EDITS):
        self.q, self.words, self.edits = q, words, edits
        self.texts, self.items = list(texts), list(texts.values())
        self.codes, self.windows = [], []
        grams, owner, place = [], [], []
        for i, t in enumerate(self.texts):
            c = _codes(t)
            starts = np.concatenate([[0], np.flatnonzero(c == 32) + 1])
            ends = np.append(starts[1:] - 1, len(c))
            n = max(0, len(starts) - words + 1)
            self.codes.append(c)
            self.windows.append(np.stack([starts[:n], ends[words - 1 : words - 1 + n]], 1) if n and len(c) else np.zeros((0, 2), np.int64))
            if len(self.windows[-1]):
                g = _grams(c, q)
                grams.append(g)
                owner.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        g, o, p = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((grams, np.uint64), (owner, np.int64), (place, np.int64)))
        order = np.argsort(g, kind="stable")
        self.owner, self.place = o[order], p[order]
        self.keys, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.bits = max(16, int(math.ceil(math.log2(max(1, len(self.keys)) * 24))))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.keys >> np.uint64(64 - self.bits)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, passage, position in it) of each shared q-gram."""
        out = []
        step = 1 << 21
        for s in range(0, max(0, len(codes) - self.q + 1), step):
            g = _grams(codes[s : s + step + self.q - 1], self.q)
            at = np.flatnonzero(self.bitmap[g >> np.uint64(64 - self.bits)])
            if not len(at) or not len(self.keys):
                continue
            k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            same = self.keys[k] == g[at]
            at, k = at[same], k[same]
            n = self.first[k + 1] - self.first[k]
            post = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(at, n) + s, self.owner[post], self.place[post]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def least(self, lengths: np.ndarray) -> np.ndarray:
        """Shared q-grams that the lemma demands of windows of these lengths (at least one)."""
        return np.maximum(1, lengths + 1 - self.q * (self.edits + 1))


def banded(a: list[np.ndarray], b: list[np.ndarray], shift: int) -> np.ndarray:
    """Least edits that turn each a into some stretch of its b.

    b[i] starts `shift` places before where a[i] is expected; only diagonals within `shift` of
    that are looked at. All pairs advance together, row by row.
    """
    n, width = len(a), 2 * shift + 1
    length = np.array([len(x) for x in a])
    rows = int(length.max(initial=0))
    x = np.zeros((n, rows), np.uint32)
    y = np.zeros((n, rows + width), np.uint32)
    for i in range(n):
        x[i, : len(a[i])] = a[i]
        part = b[i][: rows + width]
        y[i, : len(part)] = part
    big = np.int32(1 << 20)
    cost = np.zeros((n, width), np.int32)  # a stretch of b may start on any diagonal
    result = np.where(length == 0, 0, big)
    for r in range(rows):
        new = cost + (x[:, r, None] != y[:, r : r + width])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        for d in range(1, width):
            new[:, d] = np.minimum(new[:, d], new[:, d - 1] + 1)
        cost = new
        ended = length == r + 1
        result[ended] = cost[ended].min(1)
    return result


def search(texts: list[str], index: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, window, edits) of all windows found in normalised texts."""
    codes = _codes("\n".join(texts))
    start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    pos, who, place = index.hits(codes)
    doc = np.searchsorted(start, pos, "right") - 1
    band = 2 * (index.edits + 1)
    diagonal = pos - start[doc] - place
    found: list[tuple[int, int, int, int, int]] = []
    shortest = np.array([int((w[:, 1] - w[:, 0]).min()) if len(w) else 1 << 30 for w in index.windows])
    demand = index.least(shortest)
    for half in (0, band // 2):
        b = (diagonal + half) // band
        # counts of hashed (text, passage, band) are never too low: most hits fall before any sorting
        with np.errstate(over="ignore"):
            key = (((doc * 0x9E3779B1 + who) * 0x85EBCA77 + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)
        many = np.flatnonzero(np.bincount(key.astype(np.int64), minlength=1 << 21)[key] >= demand[who])
        order = many[np.lexsort((place[many], b[many], who[many], doc[many]))]
        d, w, k, p, g = doc[order], who[order], b[order], place[order], diagonal[order]
        if not len(d):
            continue
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(d)))
        enough = size >= demand[w[first]]
        for f, n in zip(first[enough], size[enough], strict=True):
            i = int(w[f])
            win = index.windows[i]
            at = np.unique(p[f : f + n])
            count = np.searchsorted(at, win[:, 1] - index.q, "right") - np.searchsorted(at, win[:, 0])
            centre = int(k[f]) * band - half + band // 2
            found += [(int(d[f]), i, int(j), centre, int(g[f])) for j in np.flatnonzero(count >= index.least(win[:, 1] - win[:, 0]))]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    cand = np.unique(np.array([c[:4] for c in found]), axis=0)
    reach = band // 2 + index.edits
    edits = np.zeros(len(cand), np.int64)
    for s in range(0, len(cand), 20_000):
        a, bs = [], []
        for dd, i, j, centre in cand[s : s + 20_000]:
            lo, hi = index.windows[i][j]
            from_ = start[dd] + lo + centre - reach
            stop = min(start[dd + 1] - 1, from_ + (hi - lo) + 2 * reach + 1)
            part = codes[max(start[dd], from_) : max(stop, start[dd])]
            bs.append(np.concatenate([np.zeros(max(0, start[dd] - from_), np.uint32), part]))
            a.append(index.codes[i][lo:hi])
        edits[s : s + 20_000] = banded(a, bs, reach)
    ok = edits <= index.edits
    cand, edits = cand[ok], edits[ok]
    order = np.lexsort((edits, cand[:, 2], cand[:, 1], cand[:, 0]))
    cand, edits = cand[order], edits[order]
    keep = np.ones(len(cand), bool)
    keep[1:] = (cand[1:, :3] != cand[:-1, :3]).any(1)
    cand, edits = cand[keep], edits[keep]
    return cand[:, 0], cand[:, 1], cand[:, 2], edits


SCHEMA = "doc_id bigint, item_id bigint, windows int, edits int, exact boolean"


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = EDITS, q: int = Q) -> DataFrame:
    """One row (doc_id, item_id, windows, edits, exact) for each document that holds a passage's
    window of `words` words with at most `edits` edits.

    `windows` is how many windows occur, `edits` the fewest edits of one, `exact` whether at least
    `words` consecutive words agree. Null or short passages and null or empty texts match nothing.
    """
    spark = documents.sparkSession
    asked = items.filter("passage is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "passage")
    total = asked.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    docs = documents.filter("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == block)
        texts: dict[str, set[int]] = {}
        for item, passage in mine.collect():
            texts.setdefault(normalise(passage), set()).add(item)
        shared = spark.sparkContext.broadcast(Passages({t: sorted(i) for t, i in sorted(texts.items())}, q, words, edits))

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                for s in range(0, b.num_rows, 1000):
                    part = b.slice(s, 1000)
                    ids, plain = part.column(0).to_pylist(), normalise_all(part.column(1).to_pylist())
                    doc, who, win, cost = search(plain, index)
                    rows: dict[tuple[int, int], list] = {}
                    for d, i, j, e in zip(doc.tolist(), who.tolist(), win.tolist(), cost.tolist(), strict=True):
                        row = rows.setdefault((d, i), [0, e, False])
                        row[0] += 1
                        row[1] = min(row[1], e)
                        if e == 0 and not row[2]:
                            lo, hi = index.windows[i][j]
                            row[2] = f" {index.texts[i][lo:hi]} " in f" {plain[d]} "
                    flat = [(ids[d], item, *row) for (d, i), row in rows.items() for item in index.items[i]]
                    if flat:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["doc_id", "item_id", "windows", "edits", "exact"])

        found = docs.mapInArrow(run, SCHEMA)
        out = found if block == 0 else out.unionByName(found)
    return out


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(*_tables(spark, sf)).filter("exact").select("doc_id", "item_id").distinct()


def p7_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Also passages that occur with a few edits."""
    return leaks(*_tables(spark, sf))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """How often each item leaked."""
    items = _tables(spark, sf)[1].select("item_id", "suite")
    hits = p7_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("_n", F.lit(0)).alias("documents"))
