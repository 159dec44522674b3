"""Shared helpers of the corpus operators: table reading and numpy kernels on Arrow text.

The kernels work on the contiguous UTF-8 buffer behind an Arrow string column, cut
into blocks of a few MB so that the numpy temporaries stay small whatever the batch
size; a single longer text forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20
SHINGLE_WORDS = 5
# The white space of the contracts, \x20 and \x09 to \x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(columns: list[str]) -> str:
    """A prefix of underscores that no column's name has: helper columns under it clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between JVM and Python by bytes: whole texts pass through
    them, and 10,000 rows (the default) of long ones fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_blocks(batches, column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = string_view(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def string_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    if array.null_count:
        array = pc.fill_null(array, "")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[raw[0] : raw[-1]], raw - raw[0]


def byte_set(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars.encode("latin-1"), dtype=np.uint8)] = True
    return table


SPACE_BYTES = byte_set(WHITE_SPACE)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE_BYTES):
    """(start, end, document) of each maximal run of bytes that are not separators."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


SAME_BYTES = np.arange(256, dtype=np.uint8)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = ASCII_LOWER) -> np.ndarray:
    """64-bit hash of each span of bytes, mapped by ``table`` (A-Z lower-cased unless another is given)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    where = np.arange(int(lengths.sum()), dtype=np.int64)
    place = where - np.repeat(first, lengths)
    where += np.repeat(starts - first, lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = _MULT
    np.cumprod(power, out=power)
    terms = (table[data[where]].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _MIX1)


_SHINGLE_POWERS = np.cumprod(np.full(SHINGLE_WORDS, 0xD6E8FEB86659FD93, np.uint64))


def shingle_hashes(words: np.ndarray, documents: np.ndarray, size: int = SHINGLE_WORDS):
    """(hash, document) of every run of ``size`` words inside one document; a document
    with fewer words gives its whole sequence as one shingle. Repeats are kept."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers = np.cumprod(np.full(size, 0xD6E8FEB86659FD93, np.uint64))
    full = np.zeros(0, np.int64)
    if n >= size:
        full = np.flatnonzero(documents[: n - size + 1] == documents[size - 1 :])
    value = np.zeros(len(full), np.uint64)
    for j in range(size):
        value += words[full + j] * powers[j]
    first = np.flatnonzero(np.r_[True, documents[1:] != documents[:-1]])
    count = np.diff(np.r_[first, n])
    first, count = first[count < size], count[count < size]
    short = count.astype(np.uint64) * _MIX2
    for j in range(size - 1):
        has = count > j
        short[has] += words[first[has] + j] * powers[j]
    hashes = mix64(np.concatenate([value, short]))
    owners = np.concatenate([documents[full], documents[first]])
    return hashes, owners


def distinct_per_document(hashes: np.ndarray, owners: np.ndarray):
    """Sorted distinct hashes of each document, documents in order."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]
        hashes, owners = hashes[keep], owners[keep]
    return hashes, owners


def shingle_sets(array: pa.Array):
    """(hashes, offsets): each text's distinct five-word shingles, sorted."""
    data, offsets = string_view(array)
    starts, ends, documents = word_spans(data, offsets)
    hashes, owners = shingle_hashes(hash_spans(data, starts, ends), documents)
    hashes, owners = distinct_per_document(hashes, owners)
    return hashes, np.searchsorted(owners, np.arange(len(array) + 1))


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Arrow list<int64> from flat 64-bit values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))
