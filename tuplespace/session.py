"""Session helpers: a local session for tests and a shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "tuplespace") -> SparkSession:
    """Local session used by tests and the bench; a cluster passes its own session."""
    shared = os.environ.get("TUPLESPACE_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="tuplespace-ckpt-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Intermediate tables are read by every executor, so there is no fallback to a
    machine-local folder on a cluster: a session without ``spark.checkpoint.dir`` is
    refused. Only a local master (one machine, as in tests) gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tuplespace-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint base for a materialised table."""
    return f"{checkpoint_base(spark).rstrip('/')}/tuplespace/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "stage", partition_by: tuple[str, ...] = ()):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This is the lineage cut used wherever two passes must see the same rows (for
    example partition-local numbering): the written table survives executor loss,
    costs one job, and the read-back is columnar with file statistics. Never a local
    checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with job_label(spark, f"write {name}"):
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if partition_by else out
    out._tuplespace_path = path
    return out


def drop_table(df) -> None:
    """Delete the folder behind a table made by :func:`cut_lineage` (no further use)."""
    path = getattr(df, "_tuplespace_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours under the checkpoint base, through the file system Spark uses."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def publish_file(df, folder: str, name: str) -> None:
    """Write the few rows of ``df`` as the one file ``<folder>/<name>.parquet``, which appears whole; if it is
    there already, nothing is written. The unfinished file lies beside the folder."""
    spark, final = df.sparkSession, f"{folder}/{name}.parquet"
    if path_exists(spark, final):
        return
    unfinished = f"{folder}-unfinished/{name}"
    df.coalesce(1).write.mode("overwrite").parquet(unfinished)
    source = spark._jvm.org.apache.hadoop.fs.Path(unfinished)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in files.listStatus(source):
        if s.getPath().getName().endswith(".parquet"):
            if not files.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(final)):
                raise OSError(f"could not publish {final}")
    files.delete(source, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right under ``path``, through the file system Spark uses; none if there is no such path."""
    if not path_exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [s.getPath().toString() for s in found if s.isDirectory()]


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Shuffle files of the jobs inside go when each job ends. By default they stay until the driver collects its
    garbage, so writes one after another pile them up. For writes only: nothing inside may be run a second time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class job_label:
    """Context manager naming the Spark jobs started inside it (event log / UI)."""

    def __init__(self, spark: SparkSession, text: str):
        self.sc, self.text = spark.sparkContext, text

    def __enter__(self):
        self.prev = self.sc.getLocalProperty("spark.job.description")
        self.sc.setJobDescription(f"tuplespace: {self.text}")
        return self

    def __exit__(self, *exc):
        self.sc.setJobDescription(self.prev)
        return False
