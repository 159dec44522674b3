"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector less the mean is padded, rotated by a seeded random rotation and reduced to
the signs of its ``CODE_BITS`` coordinates, packed in 64-bit words, with correction
scalars: its length and the inner product of its direction with its code. A query,
rotated alike and rounded to ``PLANES`` bit planes, meets packed codes by bit counts;
the scalars turn counts into an estimate of the inner product with an error bound.
In each block the vectors with the best estimates are scored exactly, and then every
vector whose estimate plus bound reaches the k-th of these scores. So a neighbour is
lost only where the bound fails, at ``SPREAD`` standard deviations.

Every row is indexed. Queries meet all vectors block by block: a pair of a query
block and a vector block is one group of bounded size, and gives at most k rows a
query.

Cases: rows without an id, and vectors that are null, zero, of another length than
most, or hold null or non-finite components, take no part. A query's own row is the
one with its id; where rows repeat a query's id its vector is the smallest of them.
Equal scores go to the smaller id. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.session import cut_lineage

NEIGHBOURS = 20
QUERY_EVERY = 20
CODE_BITS = 256
PLANES = 6
SPREAD = 4.0
VECTOR_BLOCK, QUERY_BLOCK, QUERY_STEP = 4096, 4096, 128
SEED = 17


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").head()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def mean_vector(rows: DataFrame, d: int) -> np.ndarray:
    def run(batches):
        total, n = np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                total += matrix(batch.column("v")).sum(axis=0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total), pa.array(np.full(d, n))],
                                         names=["k", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "k int, total double, n long").groupBy("k").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # d rows
    mean = np.zeros(d)
    for r in sums:
        mean[r.k] = round(r.total / max(r.n, 1), 9)  # the order of summing leaves no trace
    return mean


def rotation(d: int, bits: int) -> np.ndarray:
    """(d, bits): orthonormal rows, the part of a random rotation that the padding leaves."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, d)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """Packed signs and correction scalars of a block of vectors."""

    def __init__(self, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        bits = turn.shape[1]
        turned = (vectors - mean) @ turn
        self.length = np.linalg.norm(turned, axis=1)
        signs = turned > 0
        self.words = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.agreement = np.abs(turned).sum(axis=1) / (self.length * np.sqrt(bits))
        self.agreement[self.length == 0] = 1.0


def pack(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
    c = Codes(vectors, mean, turn)
    return c.words, c.length, c.agreement


def estimates(queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, words, length, agreement):
    """(estimate, bound) of all inner products, queries in rows."""
    bits = turn.shape[1]
    turned = queries @ turn
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    levels = np.rint((turned - low) / step).astype(np.uint8)
    counts = np.zeros((len(queries), len(words)), np.int32)
    for plane in range(PLANES):
        mask = np.packbits((levels >> plane) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(words.shape[1]):
            counts += np.bitwise_count(mask[:, w, None] & words[None, :, w]).astype(np.int32) << plane
    ones = np.bitwise_count(words).sum(axis=1)
    rounded_sum = (low + step * levels).sum(axis=1, keepdims=True)
    # Twice the sum over the code's ones less the whole sum: the product with its signs.
    signed = (2 * (step * counts + low * ones[None, :]) - rounded_sum) / np.sqrt(bits)
    estimate = (queries @ mean)[:, None] + signed * (length / agreement)[None, :]
    norm = np.linalg.norm(turned, axis=1, keepdims=True)
    slip = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement * SPREAD / np.sqrt(max(bits - 1, 1))
    rounding = step * np.sqrt(1 / 12) * SPREAD  # of independent coordinates
    bound = length[None, :] * (norm * slip[None, :] + rounding / agreement[None, :])
    return estimate, bound + 1e-9 * (1 + np.abs(estimate))


def exact(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, summed component by component in double precision."""
    out = np.zeros(len(q))
    for k in range(queries.shape[1]):
        out += queries[q, k] * vectors[v, k]
    return out


def block_neighbours(query_ids, queries, ids, vectors, coded, mean, turn, k: int):
    """(query row, vector row, score): of each query the k best of the block, as far as the bounds hold."""
    words, length, agreement = coded
    found = []
    for begin in range(0, len(queries), QUERY_STEP):
        own = queries[begin : begin + QUERY_STEP]
        estimate, bound = estimates(own, mean, turn, words, length, agreement)
        self_pair = query_ids[begin : begin + QUERY_STEP, None] == ids[None, :]
        estimate[self_pair] = -np.inf
        some = min(k, len(ids))
        first = np.argpartition(-estimate, some - 1, axis=1)[:, :some]
        rows = np.repeat(np.arange(len(own)), some)
        scores = exact(own, vectors, rows, first.ravel())
        scores[self_pair[rows, first.ravel()]] = -np.inf
        reached = scores.reshape(first.shape).min(axis=1) if some == k else np.full(len(own), -np.inf)
        chosen = (estimate + bound >= reached[:, None]) & ~self_pair
        q, v = np.nonzero(chosen)
        scores = exact(own, vectors, q, v)
        order = np.lexsort((ids[v], -scores, q))
        q, v, scores = q[order], v[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < k
        found.append((q[best] + begin, v[best], scores[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY,
            k: int = NEIGHBOURS) -> DataFrame:
    """Of each query (id divisible by ``every``) its ``k`` nearest: query_id, rank, vec_id, score."""
    rows, d = usable(vectors, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    if not d:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean, turn = mean_vector(rows, d), rotation(d, max(CODE_BITS, -(-d // 64) * 64))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, length, agreement = pack(matrix(batch.column("v")), mean, turn)
            flat = pa.array(words.ravel().view(np.int64))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, flat), pa.array(length),
                 pa.array(agreement)], names=["vec_id", "v", "code", "length", "agreement"])

    coded = rows.mapInArrow(index, "vec_id long, v array<double>, code array<long>, length double, agreement double")
    coded = cut_lineage(coded.withColumn("row", F.monotonically_increasing_id()), "one-bit-codes")
    queries = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_queries = coded.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    left = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("qb"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("vb"))
    right = coded.select("vec_id", "v", "code", "length", "agreement", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("vb"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"))

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        query_ids, ids = (np.asarray(t.column(c).combine_chunks()) for t, c in ((queries, "query_id"), (found, "vec_id")))
        words = np.asarray(found.column("code").combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
        scalars = [np.asarray(found.column(c).combine_chunks()) for c in ("length", "agreement")]
        q, v, score = block_neighbours(query_ids, matrix(queries.column("v")), ids, matrix(found.column("v")),
                                       (words, *scalars), mean, turn, k)
        return pa.table({"query_id": query_ids[q], "vec_id": ids[v], "score": score})

    meet.__annotations__ = {"queries": pa.Table, "found": pa.Table, "return": pa.Table}
    best = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
