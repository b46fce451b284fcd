"""Session settings, shared storage and other things that every operator needs."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset and Spark runs on this machine alone (tests) a temporary folder takes
    its place. On a cluster executors would write to their own disks, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryset-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


class Scratch:
    """Tables written in the shared folder, which cut lineage and survive a lost executor.

    `write` returns the table read back. `drop` deletes one that nothing reads any more; what is
    left goes when Python ends, because results are lazy and may still be read. Shuffle files of a
    write are deleted when it is over, since its table replaces them.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/quarryset/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._tables: list[str] = []
        atexit.register(self._end)

    def _path(self, tag: str) -> str:
        self._n += 1
        return f"{self.base}/{tag}-{self._n}"

    @contextmanager
    def _cleaning(self):
        before = self.spark.conf.get(self._CLEAN, "false")
        self.spark.conf.set(self._CLEAN, "true")
        try:
            yield
        finally:
            self.spark.conf.set(self._CLEAN, before)

    def write(self, df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self._path(tag)
        with self._cleaning():
            w = df.write.mode("overwrite")
            if partition_by:
                w = w.partitionBy(*partition_by)
            w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, tag: str, n: int, *by: str) -> DataFrame:
        """Stores rows in n buckets by the hash of some columns, so that later joins and groups on
        these columns need no shuffle of the table. `df` should come in these partitions already
        (`repartition(n, *by)`), which makes one file a bucket."""
        path, name = self._path(tag), f"quarryset_{tag}_{uuid.uuid4().hex[:12]}"
        with self._cleaning():
            df.write.mode("overwrite").format("parquet").bucketBy(n, *by).option("path", path).saveAsTable(name)
        self._tables.append(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            name = getattr(t, "_scratch_table", None)
            if name:
                self.spark.sql(f"drop table if exists {name}")
                self._tables.remove(name)
            path = getattr(t, "_scratch_path", None)
            if path:
                _remove(self.spark, path)

    def _end(self) -> None:
        for name in self._tables:
            try:
                self.spark.sql(f"drop table if exists {name}")
            except Exception:  # the session may be gone already
                break
        _remove(self.spark, self.base)


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of tasks for `rows` rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_task))
