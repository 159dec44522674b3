"""Load a materialised table if it exists, else build, write and read it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for any
    cluster file system, not only the local disk)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")))


def load_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    if not path_exists(spark, path):
        builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
