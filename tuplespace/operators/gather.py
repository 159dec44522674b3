"""Distances of pairs by a blocked gather: pairs carry ids, vectors go once to each cell.

Items are hashed into blocks. A pair belongs to the cell (block of its first item, block of its
second item); a cell with many pairs is dealt to several cells. Each cell gets the vector of each
of its distinct items once, whatever the number of its pairs, so a second item that a third of
all pairs share travels once per cell instead of once per pair. ``layout`` counts the pairs and
their distinct items and takes the blocks that send fewer vectors: both sides in blocks of a bounded
number of vector bytes (few items, many pairs), or cells of about ``CELL_PAIRS`` rows by the first
item alone. Rows with more than two ids (tuples) go by their first.

Vectors that fit into one block together (their bytes are counted) are broadcast instead: the
pairs then stay where they are.

Rows: a pair with a null id or with an item that has no vector row goes (an inner join); a
repeated pair stays repeated; an item with several vector rows gives a row for each; a null
vector or two lengths give a null distance. Tables may be empty. A cell's task holds two
blocks of vectors and ``DENSE_PAIRS`` ids at most, or the vectors and ids of ``CELL_PAIRS`` rows,
give or take the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespace.functions.vectors import _sq_dist_arrow, with_sq_distances
from tuplespace.session import cut_lineage, drop_table, dropped_shuffles, scratch_path

BLOCK_BYTES = 32 << 20  # vector bytes of a block of items
VALUE_BYTES = 8  # of a vector element, at most
CELL_PAIRS = 65_536  # pairs of a cell on average
DENSE_PAIRS = 1 << 21  # pairs of a cell of two blocks, at most
HELD_BLOCKS = 4  # blocks that a cell of two blocks may hold of either side
TUPLE_ROWS = 1 << 18  # rows with more than two ids of a cell, at most
PASS_BYTES = 512 << 20  # of vectors and ids sent at once by ``distances_in_passes``, about, or as much as all vectors if that is more
PAIR_BYTES = 48  # of a pair's ids and cell on its way, about
SLICE_ROWS = 8_192  # pairs whose vectors a kernel lays side by side at once
_CELL = ("_block_1", "_block_2", "_part")


def block_count(vectors: DataFrame, vec_col: str = "ev", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of items so that one holds about ``block_bytes`` of vectors (one pass over the lengths)."""
    values = vectors.agg(F.sum(F.coalesce(F.array_size(vec_col), F.lit(0)).cast("long"))).first()[0] or 0
    return max(1, -(-values * VALUE_BYTES // block_bytes))


def numbered_rows(rows: DataFrame, columns, ids) -> DataFrame:
    """The rows without a null id, written once with a number for each, so that every reader sees the same."""
    whole = rows.select(*dict.fromkeys([*columns, *ids])).dropna(subset=list(ids))
    return cut_lineage(whole.withColumn("_row", F.monotonically_increasing_id()), "gather-rows")


def layout(numbered: DataFrame, ids, blocks: int, cell_pairs: int = CELL_PAIRS) -> tuple[int, int, int]:
    """(blocks of the first item, of the second, rows of a cell) that send the fewer vectors, from the counted rows
    and (about) distinct items; ``blocks`` is the number all items with vectors would make. An item is sent once to each
    of its cells, and never more often than it has rows. Cells of two blocks are as large as a task may hold: the
    fewer there are, the fewer copies of the other side's items are sent."""
    if len(ids) != 2:
        return max(1, -(-numbered.count() // cell_pairs)), 1, cell_pairs
    n, first, second = (max(1, v) for v in numbered.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in ids]).first())
    by_first = -(-n // cell_pairs)
    whole = max(first, second) * HELD_BLOCKS
    k1, k2 = (max(1, -(-blocks * k // whole)) for k in (first, second))
    k1 = max(k1, -(-4 * n // (3 * k2 * DENSE_PAIRS)))  # a quarter of room, so that an ordinary cell is not parted
    dense = min(n, first * k2) + min(n, second * k1)
    if dense < first + min(n, second * by_first):
        return k1, k2, DENSE_PAIRS
    return by_first, 1, cell_pairs


def dealt_rows(numbered: DataFrame, columns, ids, cells: tuple[int, int, int]) -> DataFrame:
    """The numbered rows with the cell they belong to; the equal rows of a hot pair are parted too."""
    k1, k2, cell_rows = cells
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    placed = numbered.withColumns({_CELL[0]: block(ids[0], k1), _CELL[1]: block(ids[1], k2)})
    parts = placed.groupBy(*_CELL[:2]).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).alias("_parts"))
    # a row per pair of blocks: broadcast, the rows stay where they are
    return placed.join(F.broadcast(parts), list(_CELL[:2])).select(
        *dict.fromkeys([*columns, *ids]), *_CELL[:2], F.pmod(F.col("_row"), F.col("_parts")).cast("int").alias(_CELL[2]))


def dealt_pairs(pairs: DataFrame, keep, a: str, b: str, blocks: int, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """The pairs with the cell they belong to, both items in ``blocks`` blocks."""
    return dealt_rows(numbered_rows(pairs, keep, (a, b)), keep, (a, b), (blocks, blocks, cell_pairs))


def wanted_items(dealt: DataFrame, *ids: str) -> DataFrame:
    """Distinct (cell, item): the vectors that are sent, one row each."""
    return dealt.select(*_CELL, F.explode(F.array(*ids)).alias("_item")).distinct()


def _by_broadcast(pairs, vectors, keep, a, b, out, vec_col, sqrt) -> DataFrame:
    side = lambda c: F.broadcast(vectors.select(F.col("item_id").alias(c), F.col(vec_col).alias(f"_vec_{c}")))
    return with_sq_distances(pairs.join(side(a), a).join(side(b), b), [(f"_vec_{a}", f"_vec_{b}", out)], keep, sqrt)


def blocked_distances(pairs: DataFrame, vectors: DataFrame, keep, a: str = "item_id_1", b: str = "item_id_2",
                      out: str = "eu", vec_col: str = "ev", sqrt: bool = False, blocks: int | None = None,
                      cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``keep`` columns of the pairs and the squared (or plain, with ``sqrt``) distance of their two items.
    ``blocks`` is the least number of blocks; more are made if the bytes of the vectors call for them."""
    held = block_count(vectors, vec_col)
    if blocks is None and held == 1:
        return _by_broadcast(pairs, vectors, keep, a, b, out, vec_col, sqrt)
    numbered = numbered_rows(pairs, keep, (a, b))
    cells = layout(numbered, (a, b), held, cell_pairs) if blocks is None else (max(blocks, held),) * 2 + (cell_pairs,)
    return _measured(dealt_rows(numbered, keep, (a, b), cells), vectors, [(a, b, out)], keep, vec_col, None, sqrt)


def pass_layout(n: int, first: int, second: int, held: int, least: int, cell_pairs: int = CELL_PAIRS) -> tuple[tuple[int, int, int], int]:
    """((blocks of the first item, of the second, pairs of a cell), vectors sent) of ``n`` pairs: of the two layouts of
    :func:`layout`, each in ``least`` blocks of either side or more, the one that sends fewer."""
    whole = max(first, second) * HELD_BLOCKS
    k1, k2 = (max(least, -(-held * k // whole)) for k in (first, second))
    dense = (max(k1, -(-4 * n // (3 * k2 * DENSE_PAIRS))), k2, DENSE_PAIRS)
    by_first = (max(least, -(-n // (cell_pairs * least))), least, cell_pairs)
    sent = lambda c: min(n, first * c[1]) + min(n, second * c[0])
    best = min(dense, by_first, key=sent)
    return best, sent(best)


def distances_in_passes(pairs: DataFrame, vectors: DataFrame, keep, by: str, a: str = "item_id_1", b: str = "item_id_2", out: str = "eu",
                        vec_col: str = "ev", sqrt: bool = False, blocks: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``blocked_distances`` with a bound on the disk: written pass by pass. The pairs of each value of ``by`` (one of
    ``keep``, few values) have a layout of their own, from their counted rows and distinct items; a pass takes some of
    its blocks of first items, and what it sends goes when its distances are written."""
    spark, path = pairs.sparkSession, scratch_path(pairs.sparkSession, "distances")
    with dropped_shuffles(spark):
        numbered = numbered_rows(pairs, keep, (a, b))
    values, items = vectors.agg(F.sum(F.coalesce(F.array_size(vec_col), F.lit(0)).cast("long")), F.count(F.lit(1))).first()
    size = VALUE_BYTES if vectors.schema[vec_col].dataType.elementType.typeName() == "double" else VALUE_BYTES // 2
    held, at_once = max(blocks, -(-(values or 0) * VALUE_BYTES // BLOCK_BYTES)), max(PASS_BYTES, (values or 0) * size)
    counts = numbered.groupBy(by).agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in (a, b)])
    schema = T.StructType([*[numbered.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    written = []
    for value, n, first, second in counts.collect():  # a row per value of ``by``
        cells, sent = pass_layout(n, first, second, held, blocks, cell_pairs)
        own, block = numbered.where(F.col(by).eqNullSafe(F.lit(value))), F.pmod(F.xxhash64(a), F.lit(cells[0]))
        passes = min(cells[0], max(1, -(-(sent * size * (values or 0) // max(1, items) + n * PAIR_BYTES) // at_once)))
        for k in range(passes):
            some = own.where((block >= k * cells[0] // passes) & (block < (k + 1) * cells[0] // passes))
            written.append(f"{path}/pass-{len(written)}")
            with dropped_shuffles(spark):
                _measured(dealt_rows(some, keep, (a, b), cells), vectors, [(a, b, out)], keep, vec_col, None, sqrt).write.parquet(written[-1])
    drop_table(numbered)
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def gathered_distances(rows: DataFrame, vectors: DataFrame, specs, keep, vec_col: str = "ev", scale_col: str | None = None,
                       sqrt: bool = False, blocks: int = 2, cell_rows: int = CELL_PAIRS) -> DataFrame:
    """``keep`` columns of the rows and the distance of every (id, id, out) of ``specs``, each item's vector
    multiplied by ``scale_col`` if there is one. The first id of the first spec deals the rows. The numbered rows
    stay on disk until ``drop_gathered``."""
    ids = list(dict.fromkeys(c for a, b, _ in specs for c in (a, b)))
    numbered = numbered_rows(rows, keep, ids)
    dealt = dealt_rows(numbered, keep, ids, layout(numbered, ids, blocks, cell_rows))
    out = _measured(dealt, vectors, specs, keep, vec_col, scale_col, sqrt)
    out._gathered_from = numbered
    return out


def drop_gathered(distances: DataFrame) -> None:
    """Delete the numbered rows behind the result of a gather (no further use of it)."""
    numbered = getattr(distances, "_gathered_from", None)
    if numbered is not None:
        drop_table(numbered)


def tuple_rows(value_count: int, items: int) -> int:
    """Rows of a cell of tuples so that it holds ``HELD_BLOCKS`` blocks for each of four ids at most, were all its items distinct."""
    return max(1024, min(TUPLE_ROWS, HELD_BLOCKS * BLOCK_BYTES * max(1, items) // (VALUE_BYTES * max(1, value_count))))


def _measured(dealt: DataFrame, vectors: DataFrame, specs, keep, vec_col, scale_col, sqrt) -> DataFrame:
    import pandas as pd

    ids = list(dict.fromkeys(c for a, b, _ in specs for c in (a, b)))
    scale = [] if scale_col is None else [F.col(scale_col).alias("_scale")]
    sent = wanted_items(dealt, *ids).withColumnsRenamed({c: f"{c}_in" for c in _CELL})
    held = sent.join(vectors.select(F.col("item_id").alias("_item"), F.col(vec_col).alias("_vec"), *scale), "_item")
    schema = T.StructType([*[dealt.schema[c] for c in keep], *[T.StructField(out, T.DoubleType()) for _, _, out in specs]])

    def measure(rows: pa.Table, found: pa.Table) -> pa.Table:
        items = pd.DataFrame({"id": found.column("_item").to_pandas(), "at": np.arange(found.num_rows)})
        met = pd.DataFrame({**{c: rows.column(c).to_pandas() for c in ids}, "_row": np.arange(rows.num_rows)})
        for c in ids:
            met = met.merge(items.rename(columns={"id": c, "at": f"_at_{c}"}), on=c).drop(columns=c)
        row, at = met["_row"].to_numpy(np.int64), {c: met[f"_at_{c}"].to_numpy(np.int64) for c in ids}
        vecs = found.column("_vec").combine_chunks()
        if isinstance(vecs, pa.ChunkedArray):
            vecs = pa.concat_arrays(vecs.chunks) if vecs.num_chunks else pa.array([], vecs.type)
        scale = None if scale_col is None else found.column("_scale").to_numpy()

        def side(places):  # doubles are made of a slice's vectors only
            taken = vecs.take(pa.array(places))
            return taken if scale is None else _scaled(taken, scale[places])

        columns = []
        for a, b, _ in specs:
            parts = [_sq_dist_arrow(*(side(at[c][k:k + SLICE_ROWS]) for c in (a, b))) for k in range(0, len(row), SLICE_ROWS)]
            dist = pa.concat_arrays(parts) if parts else pa.array([], pa.float64())
            columns.append(pc.sqrt(dist) if sqrt else dist)
        return pa.table([*[rows.column(c).take(pa.array(row)) for c in keep], *columns],
                        names=[*keep, *[out for _, _, out in specs]])

    return dealt.groupBy(*_CELL).cogroup(held.groupBy(*[f"{c}_in" for c in _CELL])).applyInArrow(measure, schema)


def _scaled(vecs: pa.Array, scale: np.ndarray) -> pa.Array:
    """Every vector times its factor, in double precision."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vecs), 0))
    values = np.asarray(vecs.flatten(), np.float64) * np.repeat(scale, lengths)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values), mask=vecs.is_null())
