"""Loading and storing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_collections(points: DataFrame, path: str) -> None:
    """Stores points by collection; each write replaces only the collections it holds."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def save_lists(points: DataFrame, path: str) -> None:
    """Stores vectors by inverted list, so that probes prune whole folders."""
    points.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def save_sorted(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Stores rows in the order of a key: the footers' statistics then act as the index of it."""
    docs.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def live(docs: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that no tombstone removes."""
    return docs.join(tombstones.select(key).distinct(), key, "left_anti")


def manifest(path_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(segment, rows, least, greatest) for each file of a stored table."""
    return path_rows.groupBy(F.input_file_name().alias("segment")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"))
