"""Near-duplicates by b-bit MinHash.

Each document's distinct five-word shingles get ``HASHES`` minima. Full minima make
the ``BANDS`` band keys; of each minimum only ``BITS`` low bits are kept, packed in
64-bit words. Documents that share a band key are candidates. Their similarity is
estimated from the number of agreeing low-bit groups (exclusive or, fold, bit count),
corrected for chance agreement, and pairs that may reach the threshold are confirmed
on their full shingle sets.

No group emits all its pairs. Equal sets form one class first (a hot group of copies
is one row from there on). In a band bucket each class is compared with one pivot,
the first in a seeded order, so that the buckets of a group mostly share theirs and
repeat the same few pairs. Links to pivots already join most of every group. Buckets
that still hold several components are finished exactly, by prefix filtering: their
members meet on the rare ones of their shingles, of which two sets that reach the
threshold share at least one, whatever the template that brought them into one bucket;
the estimate and the full sets then decide as above.

With 32 bands of 4 a pair at similarity 0.75 shares no band with probability 5e-6.
The slack is about five standard deviations of the estimate at 0.75 (0.041).

Cases: null or empty text has the empty set and no links. Rows that repeat an id are
rows of their own with the same component. A null id is linked like any other text,
but names no component: if a component has no other id, component_id is null and its
rows are kept (``rows_without_id`` takes one of them). Further columns of the input are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tuplespace.llm.common import long_lists, mix64, shingle_sets, small_batches, text_blocks
from tuplespace.llm.components import component_labels
from tuplespace.session import cut_lineage, drop_table

HASHES, BANDS, BITS = 128, 32, 4
THRESHOLD_PERCENT = 75
SLACK = 0.2
# Size of the table of gram counts that orders the grams of open buckets (8 MB): any size gives the same links.
RARITY_SLOTS = 1 << 20
PARITY_WORDS = ("odd0", "odd1", "odd2", "odd3")  # 64 bits each: any number gives the same links


def minima(hashes: np.ndarray, offsets: np.ndarray, count: int = HASHES) -> np.ndarray:
    """(documents, count) minima of the sets; every set must have a member."""
    rng = np.random.default_rng(20240229)
    draw = rng.integers(0, 1 << 63, size=(count, 2), dtype=np.uint64)
    out = np.empty((len(offsets) - 1, count), np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(hashes * (draw[k, 0] * np.uint64(2) + np.uint64(1)) + draw[k, 1], offsets[:-1])
    return out


def pack_low_bits(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, 64 // bits to a word."""
    low = mix64(mins) & np.uint64(2**bits - 1)
    per = 64 // bits
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits)
    return (low.reshape(len(mins), -1, per) << shifts).sum(axis=2, dtype=np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = HASHES // BANDS
    weights = np.cumprod(np.full(rows, 0xA0761D6478BD642F, np.uint64))
    folded = (mins.reshape(len(mins), BANDS, rows) * weights).sum(axis=2, dtype=np.uint64)
    return mix64(folded + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def set_digests(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits per set, null for the empty set."""
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        begins = offsets[:-1][some]
        sums = [np.add.reduceat(mix64(hashes ^ np.uint64(salt)), begins) for salt in (0, 0x8EBC6AF09C88C6E3)]
        for k, digest in zip(some.tolist(), np.stack(sums, axis=1), strict=True):
            out[k] = digest.tobytes()
    return pa.array(out, pa.binary())


def _signatures(batches):
    for block in text_blocks(batches):
        hashes, offsets = shingle_sets(block.column("text"))
        count = np.diff(offsets)
        some = np.flatnonzero(count)
        packed = np.zeros((len(some), HASHES * BITS // 64), np.uint64)
        keys = np.zeros((len(some), BANDS), np.uint64)
        if len(some):
            begins = offsets[:-1][some]
            mins = minima(hashes, np.r_[begins, len(hashes)])
            packed, keys = pack_low_bits(mins), band_keys(mins)
        ends = np.cumsum(count > 0)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(count),
             set_digests(hashes, offsets),
             long_lists(packed.ravel(), np.r_[0, ends] * packed.shape[1]), long_lists(keys.ravel(), np.r_[0, ends] * BANDS)],
            names=["doc_id", "n_shingles", "cls", "packed", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, cls (128-bit digest of the set, null if empty), packed, bands."""
    schema = "doc_id long, n_shingles long, cls binary, packed array<long>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures, schema)


def agreeing_groups(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Number of equal low-bit groups of two packed signatures, by bit counts."""
    lowest = sum(1 << k for k in range(0, 64, bits))  # the lowest bit of each group

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        shift = bits // 2
        while shift:
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
            shift //= 2
        return F.bit_count(z.bitwiseAND(F.lit(lowest - (1 << 64) if lowest >> 63 else lowest)))

    return F.lit(hashes) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from agreeing low bits, corrected for agreement by chance."""
    chance = 2.0**-bits
    return (agreeing_groups(a, b, hashes, bits) / hashes - chance) / (1 - chance)


def _sizes_fit(threshold: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold


def _may_link(threshold: int) -> Column:
    """Sizes and estimate of a and b allow the threshold."""
    return _sizes_fit(threshold) & (estimate(F.col("packed_a"), F.col("packed_b")) >= threshold / 100 - SLACK)


def _linked(a: str, b: str, threshold: int) -> Column:
    """The full sets reach the threshold."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * threshold


def _side(classes: DataFrame, s: str, *more: str) -> DataFrame:
    return classes.select(F.col("cls").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("packed").alias(f"packed_{s}"),
                          *[F.col(c).alias(f"{c}_{s}") for c in more])


def _node() -> Column:
    """A class as a node of the links: its smallest id ``rep``, or its digest if it has none. Nodes with an id come
    first, so that the smallest node of a component has its smallest id."""
    none = F.col("rep").isNull()
    return F.struct(none.alias("no_id"), F.coalesce("rep", F.lit(0)).alias("id"),
                    F.when(none, F.col("cls")).otherwise(F.lit(b"")).alias("cls"))


def _components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, comp) of every class; its own node where it has no link."""
    named = classes.select("cls", _node().alias("node")).join(labels, "node", "left")
    return named.select("cls", F.coalesce("component", "node").alias("comp"))


def _placed(crowded: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (key, cls, comp, outside) but the pivots' of all buckets; outside: not in the pivot's component."""
    pivots = named.select(F.col("cls").alias("pivot"), F.col("comp").alias("pivot_comp"))
    placed = crowded.where("cls <> pivot").join(named, "cls").join(pivots, "pivot")
    return cut_lineage(placed.select("key", "cls", "comp", (F.col("comp") != F.col("pivot_comp")).alias("outside")), "placed")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components."""
    return placed.join(placed.where("outside").select("key").distinct(), "key", "left_semi")


def _slot(grams: np.ndarray) -> np.ndarray:
    return (mix64(grams.astype(np.uint64)) & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)


def _rarity(outside: DataFrame) -> np.ndarray:
    """How many grams of the outside classes fall into each slot: a table of one size, whatever the input's."""

    def count(batches):
        total = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(_slot(batch.column("grams").flatten().to_numpy()), minlength=RARITY_SLOTS)
        some = np.flatnonzero(total)
        for begin in range(0, len(some), 1 << 16):
            part = some[begin : begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    rows = outside.select("grams").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(RARITY_SLOTS, np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return table


def rare_grams(grams: np.ndarray, rarity: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The first grams of a set in one order for all sets, rare ones first: two sets that reach the threshold share one.

    A set of n needs n - ceil(threshold * n / 100) + 1 of them; those that no outside class holds are left out.
    Also returned is how many grams of the set follow each in that order."""
    seen = rarity[_slot(grams)]
    order = np.lexsort((grams, seen))[: len(grams) + (-threshold * len(grams)) // 100 + 1]
    places = np.flatnonzero(seen[order] > 0)
    return grams[order[places]], len(grams) - 1 - places


def parity_words(grams: np.ndarray) -> np.ndarray:
    """For each of some bits whether an odd number of the set's grams falls on it, as words. Two sets differ in no more
    bits than there are grams that only one of them holds."""
    bits = 64 * len(PARITY_WORDS)
    falls = (mix64(grams.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(falls, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _first_grams(rarity: np.ndarray, threshold: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                lists = part.column("grams")
                ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                flat = lists.flatten().to_numpy()
                firsts = [rare_grams(flat[i:j], rarity, threshold) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f, _ in firsts]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*firsts, strict=True)]
                parity = np.stack([parity_words(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(part.column(c).take(rows) for c in ("cls", "n", "comp", "outside")),
                     *(pa.array(word).take(rows) for word in parity.T)],
                    names=["gram", "rest", "cls", "n", "comp", "outside", *PARITY_WORDS])

    return run


def _meetings(rows: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes of open buckets that may be linked: of different components, one of them outside.

    The members of a bucket don't meet on its key, which a template shared by many unlike texts makes one hot group,
    but on their rare grams: any two that reach the threshold share one of those, and grams of the template come last.
    The first gram that two sets share in the common order bounds what they share by what follows it in either; in the
    smaller set it must come earlier than in the other. Bits of odd count (``parity_words``) in which two sets differ
    stand for grams that only one of them holds: they bound what is shared before a pair is made."""
    sets = rows.groupBy("cls").agg(F.max("outside").alias("outside"), F.xxhash64(F.first("comp")).alias("comp")).join(grams, "cls")
    sets = sets.select("cls", F.size("grams").alias("n"), "comp", "outside", "grams")
    firsts = sets.mapInArrow(_first_grams(_rarity(sets.where("outside")), threshold),
                             "gram long, rest long, cls binary, n int, comp long, outside boolean, "
                             + ", ".join(f"{w} long" for w in PARITY_WORDS))
    firsts = cut_lineage(firsts, "rare-grams")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("gram", F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rest", "n", "comp", *PARITY_WORDS)))

    # a is the smaller set of a pair, so its gram must be followed by enough for a partner of its own size
    early = (F.col("rest") + 1) * (100 + threshold) >= F.col("n").cast("long") * (2 * threshold)
    both = F.col("n_a").cast("long") + F.col("n_b")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    reach = (F.least("rest_a", "rest_b") + 1) * (100 + threshold) >= both * threshold
    differing = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in PARITY_WORDS), F.lit(0))
    alike = (both - differing) * (100 + threshold) >= both * (2 * threshold)

    def meet(one: DataFrame, other: DataFrame) -> DataFrame:
        pairs = side(one.where(early), "a").join(side(other, "b"), "gram")
        return pairs.where((F.col("comp_a") != F.col("comp_b")) & smaller & reach & alike).select("a", "b")

    met = meet(firsts.where("outside"), firsts).union(meet(firsts.where("NOT outside"), firsts.where("outside")))
    met = cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    drop_table(firsts)
    return met


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, grams) of the classes in ``wanted`` (cls, rep), from the texts of their representatives.

    An id on several rows may bring another text's set: the digest drops it. Classes without an id
    are found by the digests of the distinct texts without an id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    schema = "cls binary, own binary, grams array<long>"
    grams = texts.join(wanted, "rep").select("cls", "text").mapInArrow(_digested, schema).where("cls = own")
    bare = texts.where("rep IS NULL").select("text").distinct()
    bare = bare.select(F.lit(None).cast("binary").alias("cls"), "text").mapInArrow(_digested, schema)
    bare = bare.join(wanted.where("rep IS NULL").select(F.col("cls").alias("own")), "own", "left_semi")
    grams = grams.select("cls", "grams").union(bare.select("own", "grams"))
    return cut_lineage(grams.dropDuplicates(["cls"]), "sets")


def _as_nodes(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of classes as links of their nodes."""
    nodes = classes.select("cls", _node().alias("node"))
    links = links.join(nodes.select(F.col("cls").alias("a"), F.col("node").alias("_a")), "a")
    links = links.join(nodes.select(F.col("cls").alias("b"), F.col("node").alias("_b")), "b")
    return cut_lineage(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "confirmed")


def _confirmed(pairs: DataFrame, grams: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as links of nodes."""
    ga = grams.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    gb = grams.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    kept = pairs.join(ga, "a").join(gb, "b").where(_linked("ga", "gb", threshold)).select("a", "b")
    return _as_nodes(kept, classes)


def _paired(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, grams) of the classes in ``pairs``."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    return _shingled(docs, wanted.join(classes.select("cls", "rep"), "cls"))


def _digested(batches):
    for block in text_blocks(batches):
        hashes, offsets = shingle_sets(block.column("text"))
        yield pa.RecordBatch.from_arrays(
            [block.column("cls"), set_digests(hashes, offsets), long_lists(hashes, offsets)], names=["cls", "own", "grams"])


def linked_rows(docs: DataFrame, threshold: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, cls, and as ``node`` the smallest node of its component
    (cls and node null if the text has no shingle)."""
    small_batches(docs.sparkSession)
    signed = cut_lineage(signatures(docs), "minhash")
    sets = signed.where("cls IS NOT NULL")
    # Equal sets have equal signatures: any row's will do for the class.
    classes = sets.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    found = (sets.where("doc_id IS NOT NULL").join(classes.withColumnRenamed("cls", "_cls"),
             (F.col("cls") == F.col("_cls")) & (F.col("doc_id") == F.col("rep")))
             .select("cls", "rep", "n_shingles", "packed", "bands").dropDuplicates(["cls"]))
    bare = sets.where("doc_id IS NULL").dropDuplicates(["cls"]).join(classes.where("rep IS NULL"), "cls")
    found = cut_lineage(found.union(bare.select("cls", "rep", "n_shingles", "packed", "bands")), "classes")
    members = found.select("cls", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("first"))
    buckets = buckets.where("size > 1").select("key", F.col("first.cls").alias("pivot"))
    crowded = cut_lineage(members.join(buckets, "key"), "buckets")  # only buckets of several classes
    pairs = (crowded.where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
             .distinct().join(_side(found, "a"), "a").join(_side(found, "b"), "b")
             .where(_may_link(threshold)))
    pairs = cut_lineage(pairs.select("a", "b").distinct(), "candidates")
    grams = _paired(docs, pairs, found)
    links = _confirmed(pairs, grams, found, threshold)
    drop_table(pairs)
    drop_table(grams)
    labels = component_labels(links)

    placed = _placed(crowded, _components(found, labels))
    drop_table(crowded)
    rows_open = _open(placed)
    grams = _shingled(docs, found.select("cls", "rep").join(rows_open.select("cls").distinct(), "cls", "left_semi"))
    met = _meetings(rows_open, grams, threshold)
    pairs = met.join(_side(found, "a"), "a").join(_side(found, "b"), "b").where(_may_link(threshold)).select("a", "b")
    more = _confirmed(pairs, grams, found, threshold)
    for table in (placed, grams, met):
        drop_table(table)
    if not more.isEmpty():
        labels = component_labels(links.union(more))

    named = _components(found, labels).withColumnRenamed("comp", "node")
    return signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "n_shingles", "cls", "node")


def _component_id() -> Column:
    return F.when(F.col("cls").isNull(), F.col("doc_id")).when(~F.col("node.no_id"), F.col("node.id"))


def kept_rows(linked: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of ``linked_rows``."""
    return linked.select("doc_id", "n_shingles", _component_id().alias("component_id"),
                         F.coalesce(F.col("doc_id") == _component_id(), _component_id().isNull()).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return kept_rows(linked_rows(docs, threshold))


def _with_digests(batches):
    for block in text_blocks(batches):
        yield pa.RecordBatch.from_arrays([*block.columns, set_digests(*shingle_sets(block.column("text")))],
                                         names=[*block.schema.names, "_cls"])


def rows_without_id(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Of the rows of ``docs`` without an id: one of each component that has no id, and those without a shingle."""
    schema = StructType([*docs.schema.fields, StructField("_cls", BinaryType())])
    bare = docs.where("doc_id IS NULL").mapInArrow(_with_digests, schema)
    first = linked.where("node.no_id AND node.cls = cls").select(F.col("cls").alias("_cls")).distinct()
    once = bare.where("_cls IS NOT NULL").dropDuplicates(["_cls"]).join(first, "_cls", "left_semi")
    return once.select(*docs.columns).unionByName(bare.where("_cls IS NULL").select(*docs.columns))
