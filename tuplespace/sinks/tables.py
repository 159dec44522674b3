"""The path index as a Parquet table sorted by path (never a driver-side dict)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Range-partitioned and sorted by (path, item_id): a lookup of one path reads
    the files whose min/max statistics cover it."""
    ranged = (index.repartitionByRange(partitions, "path", "item_id") if partitions
              else index.repartitionByRange("path", "item_id"))
    (ranged.sortWithinPartitions("path", "item_id")
     .write.mode("overwrite").parquet(path))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
