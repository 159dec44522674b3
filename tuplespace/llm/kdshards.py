"""Sharding by a k-d tree over document metadata.

A node that stands for k leaves is split in the ratio of k // 2 to the rest, at the
weighted median (weight: size in bytes) along the dimension in which it is widest,
until every node is one leaf, whose bytes are then near the target (all bytes over
the number of shards). Dimensions are the logarithm of the size, the share of bytes
beyond ASCII and the text's checksum, all functions of the text: equal texts stay together.

The rows are reduced once to weighted units, and every median is taken over these.
A unit is a cell of the dimensions' bins (at most ``CELLS``). A cell heavier than
``TOLERANCE`` of a shard is parted by text hash into parts of about half that weight, and a part
that is still too heavy, as a hot text is, by row hash. So there are at most
``CELLS`` + 6 * shards / ``TOLERANCE`` units whatever the number of rows, and none that weighs
more than the tolerance but for single rows. A level of the tree is one window over the
units, all nodes at once; nothing but the total is read by the driver. The rows are read
for the cells, the parts, the hot parts and the shards, not for each level. Slots number a shard's rows by a
distributed rank over range partitions.

Only DataFrame functions are used.

Cases: null or empty text weighs the 16 bytes of its record and has checksum 0. Null or
repeated ids and repeated rows are rows like others. With fewer rows than shards some
shards are empty. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.operators.ranks import distributed_rank
from tuplespace.session import cut_lineage, drop_table

SHARDS = 40
RECORD_BYTES = 16
TOLERANCE = 0.002  # of a shard's bytes: a unit this light goes to one side whole
DIMENSIONS = ("size_bin", "script_bin", "sum_bin")
SIZE_STEPS, SCRIPT_STEPS, SUM_BITS = 8, 16, 6  # bins per unit of ln(size), of the share beyond ASCII, and of the checksum
CELLS = 168 * (SCRIPT_STEPS + 1) * (1 << SUM_BITS)  # a text has under e^21 bytes
UNIT = (*DIMENSIONS, "part", "sub")


def points(docs: DataFrame) -> DataFrame:
    """What the tree needs of a row: id, size, checksum, bins of its dimensions and hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.octet_length(text)
    size = (length + RECORD_BYTES).cast("long")
    script = F.floor((length - F.char_length(text)) * SCRIPT_STEPS / F.greatest(length, F.lit(1)))
    checksum = F.crc32(text.cast("binary"))
    rows = docs.select(
        "doc_id", size.alias("size"), checksum.alias("text_crc32"), F.floor(F.ln(size) * SIZE_STEPS).cast("int").alias("size_bin"),
        script.cast("int").alias("script_bin"), F.shiftright(checksum, 32 - SUM_BITS).cast("int").alias("sum_bin"),
        F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("row_hash", F.xxhash64("row")).drop("row")


def _weigh(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _heavy(weighed: DataFrame, slack: float, parts: str) -> DataFrame:
    """Too heavy groups, each with the number of parts to cut it into; under all bytes / ``slack`` rows."""
    return weighed.where((F.col("bytes") > slack) & (F.col("n") > 1)).withColumn(
        parts, F.ceil(F.col("bytes") * 2 / F.lit(slack)).cast("long")).drop("bytes", "n")


def weighted_units(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their unit, units with their bytes), both written."""
    cells = cut_lineage(_weigh(rows, *DIMENSIONS), "kd-cells")
    slack = max(TOLERANCE * (cells.agg(F.sum("bytes")).first()[0] or 0) / shards, 1.0)
    heavy = _heavy(cells, slack, "parts")  # at most shards / TOLERANCE rows
    dealt = rows.join(F.broadcast(heavy), list(DIMENSIONS), "left").withColumn(
        "part", F.coalesce(F.pmod("text_hash", F.col("parts")), F.lit(0)))
    hot = cut_lineage(_heavy(_weigh(dealt.where("parts IS NOT NULL"), *DIMENSIONS, "part"), slack, "subs"), "kd-hot")
    dealt = dealt.join(F.broadcast(hot), [*DIMENSIONS, "part"], "left").withColumn(
        "sub", F.coalesce(F.pmod("row_hash", F.col("subs")), F.lit(0)))
    dealt = cut_lineage(dealt.select("doc_id", "size", "text_crc32", "row_hash", *UNIT), "kd-dealt")
    drop_table(cells)
    drop_table(hot)
    return dealt, cut_lineage(_weigh(dealt, *UNIT), "kd-units")


def grow_tree(units: DataFrame, shards: int) -> DataFrame:
    """Units with their leaf as ``shard``: every level cuts all its nodes at their weighted medians."""
    low, high = ([f(d).alias(f"{n}_{d}") for d in DIMENSIONS] for n, f in (("low", F.min), ("high", F.max)))
    whole = units.agg(*low, *high)
    level = units.withColumns({"shard": F.lit(0), "leaves": F.lit(shards)})
    for _ in range((shards - 1).bit_length()):
        nodes = level.groupBy("shard").agg(*low, *high, F.sum("bytes").alias("total"))  # at most one row a shard
        root = whole.select([F.greatest(F.col(f"high_{d}") - F.col(f"low_{d}"), F.lit(1)).alias(f"root_{d}") for d in DIMENSIONS])
        widths = {d: (F.col(f"high_{d}") - F.col(f"low_{d}")) / F.col(f"root_{d}") for d in DIMENSIONS}
        widest = F.greatest(*widths.values())
        nodes = nodes.join(F.broadcast(root)).select("shard", "total", F.coalesce(
            *[F.when(w == widest, k) for k, w in enumerate(widths.values())]).alias("dimension"))
        along = F.coalesce(*[F.when(F.col("dimension") == k, F.col(d)) for k, d in enumerate(DIMENSIONS)])
        upto = Window.partitionBy("shard").orderBy("along", *UNIT)
        cut = level.join(F.broadcast(nodes), "shard").withColumn("along", along)
        cut = cut.withColumn("middle", F.sum("bytes").over(upto) - F.col("bytes") / 2)
        half = F.floor(F.col("leaves") / 2).cast("int")
        left = (F.col("leaves") == 1) | (F.col("middle") < F.col("total") * half / F.col("leaves"))
        grown = cut_lineage(cut.select(
            *UNIT, "bytes", F.when(left, F.col("shard")).otherwise(F.col("shard") + half).alias("shard"),
            F.when(F.col("leaves") == 1, 1).when(left, half).otherwise(F.col("leaves") - half).cast("int").alias("leaves")), "kd-level")
        drop_table(level)
        level = grown
    return level.select(*UNIT, "shard")


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot."""
    rows = cut_lineage(points(docs), "kd-points")
    dealt, units = weighted_units(rows, shards)
    drop_table(rows)
    placed = dealt.join(grow_tree(units, shards), list(UNIT)).select("doc_id", "size", "text_crc32", "row_hash", "shard")
    ranked = distributed_rank(placed, ["shard", "row_hash"], "rank")
    starts = ranked.groupBy("shard").agg(F.min("rank").alias("start"))  # one row a shard
    return ranked.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The law of the tree is ``bytes``; it has no grown shard."""
    return kd_shards(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                          F.lit(None).cast("int").alias("grown_shard"))
