"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned and sorted by id, encoded, and written as ORC: the
writer lays ids out in stripes with run-length version 2, keeps row indexes of
``row_stride`` rows and a Bloom filter on ``doc_id``. A reader that asks for a few
ids skips stripes and row groups by these; a whole read splits at stripes. Text, not
ids, crosses the shuffle, and encoding and writing are one stage.

Cases: a null or empty text gives the end id alone. Null ids sort first. Rows that
repeat an id all stay, ordered by a hash of the text, then the text. Further columns
of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuplespace.llm.common import small_batches, text_blocks
from tuplespace.session import scratch_path

END_ID = 2
GROUP_BYTES = 8 << 20  # of text encoded at once: its distinct pieces are encoded once each
# Words of a-z and the letters of Latin-1: composed already, and lower-cased one by one.
_PLAIN = "^[a-zÀ-ÖØ-öø-ÿ]+$"
# ASCII punctuation that starts no contraction.
_TRAILING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL = f"(?s)(?P<tail>[{re.escape(_TRAILING)}]*)$"


class WordEncoder:
    """Ids of texts from the ids of their distinct pieces between white space.

    Exact for a tokenizer that drops white space and never joins across it (as the
    word-end BPE does). A plain word's trailing ASCII punctuation is split off (the
    pre-tokenizer parts letters and punctuation there anyway), A-Z are lower-cased
    first unless the text may hold a special token, and pieces of plain
    letters are encoded many at a time: each ends with the one id that carries the
    word-end mark. Nothing is kept from one group of texts to the next."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        split = {"type": "WhitespaceSplit"}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        both = {"type": "Sequence", "pretokenizers": [split, as_bytes]}
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": both}))
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each part's ids begin in the pool, how many, the pool) of distinct parts."""
        words = parts.to_numpy(zero_copy_only=False)
        is_plain = np.asarray(pc.match_substring_regex(parts, _PLAIN))
        numbers, sizes, pool = [], [], []
        other = [np.flatnonzero(~is_plain)]
        plain = np.flatnonzero(is_plain)
        for begin in range(0, len(plain), 512):
            some = plain[begin : begin + 512]
            ids = self.plain.encode_batch_fast([" ".join(words[some]).lower()], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                numbers.append(some)
                sizes.append(np.diff(np.r_[0, cuts]))
                pool.append(ids)
            else:
                other.append(some)
        rest = np.concatenate(other)
        for begin in range(0, len(rest), 4096):
            some = rest[begin : begin + 4096]
            found = [e.ids for e in self.full.encode_batch_fast(words[some].tolist(), add_special_tokens=False)]
            numbers.append(some)
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            pool.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        number, size = np.concatenate([*numbers, other[0][:0]]), np.concatenate([*sizes, np.zeros(0, np.int64)])
        begins, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begins[number], counts[number] = np.cumsum(size) - size, size
        return begins, counts, np.concatenate([*pool, np.zeros(0, np.int32)])

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts (an Arrow string column or a list), each followed by ``end_id``."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bounds = np.asarray(words.offsets, np.int64)
        pieces = words.flatten().dictionary_encode()
        whole = pieces.dictionary
        cores = pc.ascii_rtrim(whole, characters=_TRAILING)
        cores = pc.if_else(pc.match_substring_regex(cores, _PLAIN), cores, whole)
        tails = pc.struct_field(pc.extract_regex(whole, _TAIL), [0])
        tails = pc.if_else(pc.equal(cores, whole), "", tails)
        halves = pa.concat_arrays([cores, tails]).dictionary_encode()
        begins, counts, pool = self.parts(halves.dictionary)
        half = np.asarray(halves.indices)
        pairs = np.stack([half[: len(whole)], half[len(whole):]], axis=1).ravel()
        sizes, pool = _gather(begins, counts, pool, pairs)
        lengths = sizes[::2] + sizes[1::2]
        sizes, ids = _gather(np.cumsum(lengths) - lengths, lengths, pool, np.asarray(pieces.indices))
        ends = np.r_[0, np.cumsum(sizes)][bounds[1:]]
        return np.insert(ids, ends, end_id), np.r_[0, ends + np.arange(1, len(texts) + 1)]


def _gather(begins: np.ndarray, counts: np.ndarray, pool: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids per entry, all ids in order) of the entries with these ``numbers``."""
    sizes = counts[numbers]
    at = np.repeat(begins[numbers] - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return sizes, pool[at]


def grouped(batches, max_bytes: int = GROUP_BYTES):
    """The batches joined to groups of about ``max_bytes`` of text (a longer text is a group of its own)."""
    held, size = [], 0
    for block in text_blocks(batches, max_bytes=max_bytes):
        held.append(block)
        size += block.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    stripe_bytes: int = 16 << 20,
    row_stride: int = 2_000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending id order."""
    small_batches(docs.sparkSession)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    placed = hashed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        coder, at = WordEncoder(tokenizer), 0  # dropped at the task's end
        for block in grouped(batches):
            ids, offsets = coder.encode(block.column("text"), end_id)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("part"), pa.array(at + offsets[:-1]),
                 pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
            at += int(offsets[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = placed.mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, tokens array<int>")
    (encoded.write.mode("overwrite")
     .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", row_stride).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_token_orc(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` the scan prunes by statistics, row index and Bloom filter."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start over all files, token count and crc32 of the ids."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row per file

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                 pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.select("doc_id", "part", "start_in_part", "tokens").mapInArrow(
        run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    path = path or scratch_path(spark, "token-orc")
    write_token_orc(docs, path, tokenizer)
    return token_digest(spark, path)
