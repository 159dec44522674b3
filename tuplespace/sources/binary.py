"""Fixed-length binary vector records (10-byte id + ``dim`` float32) as a Spark data source.

The source lists files through an Arrow file system (local paths and URIs), cuts them into
splits at record boundaries, and decodes a block of records with one numpy view.
Columns that aren't asked for are not decoded: with ids alone the floats are never made
into values. The writer puts a task's records into a file of its own under
``_temporary`` and moves the files of the successful attempts into place when the job
commits, so that a lost or repeated task leaves nothing that a reader would take up.

Cases: an id is padded with blanks on the right to 10 bytes; a null or longer id, a null vector and one of
another length fail the write. Empty files and folders give no rows. A file whose size isn't a whole number of
records fails the read. Names that start with a dot or an underscore are no data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)

ID_BYTES = 10
FORMAT = "fixedvectors"
SPLIT_BYTES = 32 << 20
BLOCK_RECORDS = 1_024
COLUMNS = {"asin": "string", "iev": "array<float>"}


def _file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    parts = urlparse(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    path: str
    first: int
    records: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, dim: int, split_bytes: int, columns: list[str]):
        self.path, self.dim, self.columns = path, dim, columns
        self.size = ID_BYTES + 4 * dim
        self.per_split = max(1, split_bytes // self.size)

    def partitions(self):
        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            if f.size % self.size:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of records of {self.size}")
            n = f.size // self.size
            out += [Split(f.path, k, min(self.per_split, n - k)) for k in range(0, n, self.per_split)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as f:
            for k in range(0, partition.records, BLOCK_RECORDS):
                n = min(BLOCK_RECORDS, partition.records - k)
                raw = np.frombuffer(f.read_at(n * self.size, (partition.first + k) * self.size), np.uint8).reshape(n, self.size)
                yield pa.RecordBatch.from_arrays([self._column(c, raw) for c in self.columns], names=self.columns)

    def _column(self, name: str, raw: np.ndarray) -> pa.Array:
        if name == "asin":
            return pa.array([bytes(r).decode("ascii", "ignore") for r in raw[:, :ID_BYTES]], pa.string())
        floats = np.ascontiguousarray(raw[:, ID_BYTES:]).view("<f4").ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * self.dim), pa.array(floats, pa.float32()))


@dataclass
class Written(WriterCommitMessage):
    name: str


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dim: int, overwrite: bool):
        self.path, self.dim, self.overwrite = path.rstrip("/"), dim, overwrite
        self.pending = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.bin"
        system.create_dir(f"{path}/{self.pending}", recursive=True)
        with system.open_output_stream(f"{path}/{self.pending}/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(self._records(batch))
        return Written(name)

    def _records(self, batch: pa.RecordBatch) -> bytes:
        ids = [str(i).encode("ascii") for i in batch.column("asin").to_pylist()]
        vectors = batch.column("iev")
        if batch.column("asin").null_count or max(map(len, ids)) > ID_BYTES:
            raise ValueError(f"an id is null or longer than {ID_BYTES} bytes")
        if vectors.null_count or (np.diff(np.asarray(vectors.offsets)) != self.dim).any():
            raise ValueError(f"a vector is null or hasn't {self.dim} values")
        rows = np.empty((batch.num_rows, ID_BYTES + 4 * self.dim), np.uint8)
        rows[:, :ID_BYTES] = np.frombuffer(b"".join(i.ljust(ID_BYTES) for i in ids), np.uint8).reshape(-1, ID_BYTES)
        rows[:, ID_BYTES:] = np.asarray(vectors.flatten(), "<f4").reshape(batch.num_rows, -1).view(np.uint8)
        return rows.tobytes()

    def commit(self, messages) -> None:
        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for message in messages:
            if message is not None:
                system.move(f"{path}/{self.pending}/{message.name}", f"{path}/{message.name}")
        self._clean(system, path)

    def abort(self, messages) -> None:
        self._clean(*_file_system(self.path))

    def _clean(self, system, path: str) -> None:
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class FixedVectors(DataSource):
    """Options: ``path``, ``dim`` (default 4096), ``split_bytes``. The schema asked for says which columns are decoded."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("dim", 4096)), int(self.options.get("split_bytes", SPLIT_BYTES)),
                            schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], int(self.options.get("dim", 4096)), overwrite)


def read_image_vectors(spark: SparkSession, path: str, dim: int = 4096, columns: list[str] | None = None,
                       split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(asin, iev) of the records under ``path``, or the ``columns`` asked for."""
    spark.dataSource.register(FixedVectors)
    names = columns or list(COLUMNS)
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in names)
    return spark.read.format(FORMAT).schema(schema).option("dim", dim).option("split_bytes", split_bytes).load(path)


def write_image_vectors(rows: DataFrame, path: str, dim: int, mode: str = "overwrite") -> None:
    """Write (asin, iev) as fixed-length records."""
    rows.sparkSession.dataSource.register(FixedVectors)
    plain = rows.select(F.col("asin").cast("string").alias("asin"), F.col("iev").cast("array<float>").alias("iev"))
    plain.write.format(FORMAT).option("dim", dim).mode(mode).save(path)


def image_catalog(image_vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach image vectors to catalog metadata (inner join on the id)."""
    return image_vectors.join(catalog, "asin").select("asin", "categories", "title", "imUrl", "iev")
