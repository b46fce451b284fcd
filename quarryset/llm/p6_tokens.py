"""Encoding of a whole corpus with a public tokenizer.

The rank file is read once in each Python worker from `path` (all machines have it there); texts
go through tiktoken in Arrow batches, so the work is one pass without a shuffle. Long texts are cut
first, at places where the splitting pattern starts a new match anyway, so that memory and the
pattern's backtracking stay bounded and the ids don't change.

Null and empty texts have an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this length (in characters) are cut; pieces have about this length.
LONG = 50_000
# White space after something else always starts a match of the pattern, whatever precedes it;
# so does a sign after a letter. Cutting there leaves each match whole.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoding(path: str = PATH) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> list[str]:
    """Cuts a text at safe boundaries into pieces of about `long` characters.

    A stretch without any boundary stays whole."""
    out, start = [], 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode(text: str | None, enc: tiktoken.Encoding) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    parts = [np.asarray(enc.encode_ordinary(p), np.int32) for p in (pieces(text) if len(text) > LONG else [text])]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids, enc: tiktoken.Encoding) -> bytes:
    """The bytes of a list of ids. Only a whole text's bytes are sure to be valid UTF-8."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)


def with_ids(df: DataFrame, key: str, text: str, path: str = PATH) -> DataFrame:
    """(key, ids) of every row; other columns are not read."""
    picked = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches):
        enc = encoding(path)
        for b in batches:
            ids = [encode(t, enc) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return picked.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_text(df: DataFrame, key: str, ids: str = "ids", path: str = PATH) -> DataFrame:
    """(key, bytes) from lists of ids; a null list gives null."""
    picked = df.select(F.col(key), F.col(ids).cast("array<int>").alias("_ids"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches):
        enc = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else decode(i, enc) for i in b.column(1).to_pylist()], pa.binary())], names=[key, "bytes"])

    return picked.mapInArrow(run, f"`{key}` {kind}, bytes binary")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return with_ids(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Number of ids of each document and whether its ids give back its bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ids = with_ids(docs, "doc_id", "text")
    back = with_text(ids, "doc_id").join(docs, "doc_id").select("doc_id", (F.col("bytes") == F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("same"))
    return ids.select("doc_id", F.size("ids").alias("n_ids")).join(back, "doc_id")


