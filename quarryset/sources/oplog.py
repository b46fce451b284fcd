"""Command logs: files of length-prefixed commands, as a Spark data source and sink.

A command is an array of texts, written `*<n>` and then `$<bytes>` and the text for each, every
line ended by CR LF. `SELECT <db>` switches the database for what follows in the same file.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, seq bigint, db int, argv array<string>"
#: Bounds of the format: arguments of a command, bytes of one argument.
MOST_ARGUMENTS, MOST_BYTES = 1 << 20, 512 << 20


def parse(data: bytes) -> Iterator[list[bytes]]:
    """Commands of a log. A command that is cut off at the end is left out; anything else that
    breaks the format raises ValueError."""
    at = 0

    def line(start: int) -> tuple[bytes, int] | None:
        end = data.find(b"\r\n", start)
        return None if end < 0 else (data[start:end], end + 2)

    while at < len(data):
        head = line(at)
        if head is None:
            return
        if not head[0].startswith(b"*") or not head[0][1:].isdigit() or int(head[0][1:]) > MOST_ARGUMENTS:
            raise ValueError(f"no command at byte {at}")
        args, pos = [], head[1]
        for _ in range(int(head[0][1:])):
            size = line(pos)
            if size is None:
                return
            if not size[0].startswith(b"$") or not size[0][1:].isdigit() or int(size[0][1:]) > MOST_BYTES:
                raise ValueError(f"no argument at byte {pos}")
            n = int(size[0][1:])
            if size[1] + n + 2 > len(data):
                return
            args.append(data[size[1] : size[1] + n])
            pos = size[1] + n + 2
        at = pos
        if args:
            yield args


def render(argv: list[str]) -> bytes:
    parts = [a.encode() for a in argv]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class OplogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(f) for f in files if os.path.isfile(f)]

    def read(self, partition: _File) -> Iterator[tuple]:
        db, seq = 0, 0
        with open(partition.path, "rb") as f:
            data = f.read()
        for args in parse(data):
            if args[0].lower() == b"select" and len(args) == 2 and args[1].isdigit():
                db = int(args[1])
                continue
            yield os.path.basename(partition.path), seq, db, [a.decode("utf-8", "replace") for a in args]
            seq += 1


class OplogSource(DataSource):
    """`spark.read.format("oplog").load(folder)`: a task for each file, `seq` counts in a file."""

    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OplogReader:
        return OplogReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OplogSource)
    return spark.read.format("oplog").load(path)


def lines(ops: DataFrame) -> DataFrame:
    """(seq, line): the log's text of each command (seq, db, argv), in the order of seq.

    Commands are range-partitioned by seq. A SELECT comes before the first command of each
    partition and wherever the database changes, so that each partition is a log of its own and
    their files, read one after the other, are the whole log.
    """

    def run(batches):
        import pyarrow as pa

        last = None
        for b in batches:
            out = []
            for db, argv in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                head = b"" if db == last else render(["SELECT", str(db)])
                last = db
                out.append(head + render(argv))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["seq", "line"])

    ordered = ops.select(F.col("seq").cast("bigint"), F.col("db").cast("int"), "argv").filter("size(argv) > 0").repartitionByRange("seq").sortWithinPartitions("seq")
    return ordered.mapInArrow(run, "seq bigint, line binary")


def write(ops: DataFrame, path: str) -> None:
    """Appends a log to a folder, a file for each partition. The line end that closes a command is
    the one that the text sink writes."""
    text = F.col("line").cast("string")
    lines(ops).select(F.substring(text, F.lit(1), F.length(text) - 2).alias("value")).write.mode("append").option("lineSep", "\r\n").text(path)
