"""Tuple assembly: anchor i, complementary c, similar s, negative n.

Rows per anchor are k_c * k_s * k_n. Three decisions keep this linear where the
result allows it:

* the pre-dedup count is a sum of grouped-count products, not a join;
* the distinct train set is the product of the *distinct* (i,c), (i,s), (i,n)
  parts (the same set as distinct-after-join, without the duplicate fan-out);
* the test split keeps one tuple per (i, c) by drawing ranks of s and n inside the
  anchor and joining on them, so it never forms the product at all.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.hashing import draw_hash, pick
from tuplespace.operators.enrich import labelled_union, with_vector_ids
from tuplespace.operators.ranks import distributed_rank, keep_ranked
from tuplespace.session import cut_lineage, drop_table


def vector_joined(comp: DataFrame, neg: DataFrame, sim: DataFrame, vectors: DataFrame):
    """comp, neg, sim restricted to pairs whose items have vectors (bag semantics)."""
    u = with_vector_ids(labelled_union(comp, neg, sim), vectors)
    rel = lambda k: u.filter(F.col("kind") == k).select("item_id_1", "item_id_2")
    return rel("comp"), rel("neg"), rel("sim")


def tuple_parts(comp_v: DataFrame, sim_v: DataFrame, neg_v: DataFrame):
    """Distinct (i,c), (i,s), (i,n), each restricted to anchors that have all three
    roles (only they form tuples). The negatives are the bulk of the pairs, so the
    semi-joins run before any rank, join or distance touches them; the result of
    every tuple operator is unchanged."""
    part = lambda df, role: df.select(
        F.col("item_id_1").alias("i"), F.col("item_id_2").alias(role)
    ).distinct()
    C, S, N = part(comp_v, "c"), part(sim_v, "s"), part(neg_v, "n")
    anchors = C.select("i").distinct().join(S.select("i").distinct(), "i").join(
        N.select("i").distinct(), "i"
    )
    keep = lambda df: df.join(anchors, "i", "left_semi")
    return keep(C), keep(S), keep(N)


# Fixed value: items per side of one cell of an anchor's product (a cell of a
# three-way product then holds up to 128**3 = 2,097,152 tuples).
CELL_SIDE = 128
PRODUCT_ROWS = 1 << 19  # rows of a product that a task makes, about (one cell may make more)


def salted_product(parts: list[tuple[DataFrame, str]], cell_side: int = CELL_SIDE) -> DataFrame:
    """Per-anchor product of the parts ``[(df(i, x, ...), x), ...]``, split into cells;
    further columns of a part (a pair's distance) are carried along.

    An anchor's product is a grid with one axis per part. Each axis is cut into
    m_x = ceil(k_x / cell_side) chunks (k_x = the anchor's rows in that part; a row
    goes to chunk xxhash64(x) mod m_x), and each cell of the grid is one join key
    (i, cell). A row is copied to every cell that shares its chunk, so every output
    row is made in exactly one cell. An ordinary anchor (all k_x <= cell_side) is one
    cell with no copies; a hot anchor is spread over prod(m_x) cells, i.e. over many
    tasks, while the copies stay a small fraction (about 1 / cell_side**(P-1) per
    part) of the output it must produce anyway. The tasks follow from the counted rows of the product:
    by the bytes of its parts, which are few and compress well, one task would make a large product alone."""
    counts = None
    for df, x in parts:
        c = df.groupBy("i").agg(F.count(F.lit(1)).alias(f"_k_{x}"))
        counts = c if counts is None else counts.join(c, "i")
    m = {x: F.greatest(F.lit(1), F.ceil(F.col(f"_k_{x}") / F.lit(cell_side))).cast("long")
         for _, x in parts}
    stride, strides = F.lit(1).cast("long"), {}
    for _, x in parts:
        strides[x] = stride
        stride = stride * F.col(f"_m_{x}")
    shares = counts.select(
        "i", *[m[x].alias(f"_m_{x}") for _, x in parts],
        *[strides[x].alias(f"_st_{x}") for _, x in parts], stride.alias("_cells"),
        reduce(mul, [F.col(f"_k_{x}").cast("double") for _, x in parts]).alias("_made"),
    )
    shares = cut_lineage(shares, "shares")
    made = shares.agg(F.sum("_made")).first()[0] or 0
    tasks = max(1, math.ceil(made / PRODUCT_ROWS))
    out = None
    for df, x in parts:
        mx, st = F.col(f"_m_{x}"), F.col(f"_st_{x}")
        own = F.pmod(F.xxhash64(x), mx)
        t = F.col("_t")
        keyed = (
            df.join(shares, "i")
            .withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_cells") / mx).cast("long") - 1)))
            .select("i", x, *_carried(df, x), (F.pmod(t, st) + own * st + F.floor(t / st) * st * mx).alias("_cell"))
            .repartition(tasks, "i", "_cell")
        )
        out = keyed if out is None else out.join(keyed, ["i", "_cell"])
    return out.select("i", *[x for _, x in parts], *[c for df, x in parts for c in _carried(df, x)])


def _carried(df: DataFrame, x: str) -> list[str]:
    return [c for c in df.columns if c not in ("i", x)]


def comp_sim(C: DataFrame, S: DataFrame) -> DataFrame:
    """Every complementary x every similar item of the anchor (distinct rows)."""
    return salted_product([(C, "c"), (S, "s")])


def assemble_train(C: DataFrame, S: DataFrame, N: DataFrame, cell_side: int = CELL_SIDE) -> DataFrame:
    """All distinct (i, c, s, n): the per-anchor product, made cell by cell so a hot
    anchor is split over many tasks (``salted_product``)."""
    return salted_product([(C, "c"), (S, "s"), (N, "n")], cell_side)


def train_slices(C: DataFrame, S: DataFrame, N: DataFrame, slice_rows: int) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The parts of the train set in slices of about ``slice_rows`` tuples each: ``assemble_train`` of each makes them. An anchor's
    tuples are in one slice, so a slice has few anchors; one with more than a sixteenth of a slice is parted by its negatives."""
    counts = None
    for df, x in ((C, "c"), (S, "s"), (N, "n")):
        c = df.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias(f"_k_{x}"))
        counts = c if counts is None else counts.join(c, "i")
    counts = cut_lineage(counts.select("i", (F.col("_k_c") * F.col("_k_s") * F.col("_k_n")).alias("_made")), "slice-counts")
    slices = max(1, math.ceil((counts.agg(F.sum("_made")).first()[0] or 0) / slice_rows))
    chunk = F.pmod(F.xxhash64("n"), F.ceil(F.col("_made") * F.lit(16) / F.lit(slice_rows)))
    placed = N.join(counts, "i").withColumn("_slice", F.pmod(F.xxhash64("i") + chunk, F.lit(slices)).cast("int")).drop("_made")
    placed = cut_lineage(placed, "slices", partition_by=("_slice",))
    drop_table(counts)
    return [(C, S, placed.where(F.col("_slice") == k).select(*N.columns)) for k in range(slices)]


def assemble_test(C: DataFrame, S: DataFrame, N: DataFrame, seed: str = "0") -> DataFrame:
    """One tuple per (i, c): s and n drawn uniformly from the anchor's distinct sets
    by hash(seed, i, c, 's'|'n'). The similar and negative sets are ranked together
    (one distributed rank over (role, i, item)); each draw is an equi-join on a
    unique rank, so a hot anchor never lands in one task and no product is formed."""
    roles = S.select(F.lit("s").alias("role"), "i", F.col("s").alias("x")).unionByName(
        N.select(F.lit("n").alias("role"), "i", F.col("n").alias("x"))
    )
    ranked = distributed_rank(roles, ["role", "i", "x"], "r")
    spans = ranked.groupBy("role", "i").agg(F.min("r").alias("start"), F.count(F.lit(1)).alias("k"))

    def role_spans(role):
        return spans.filter(F.col("role") == role).select(
            "i", F.col("start").alias(f"start_{role}"), F.col("k").alias(f"k_{role}")
        )

    base = C.join(role_spans("s"), "i").join(role_spans("n"), "i")
    hs = draw_hash(seed, F.col("i"), F.col("c"), "s")
    hn = draw_hash(seed, F.col("i"), F.col("c"), "n")
    base = base.select(
        "i",
        "c",
        (F.col("start_s") + pick(hs, F.col("k_s"))).alias("t_s"),
        (F.col("start_n") + pick(hn, F.col("k_n"))).alias("t_n"),
    )
    mem = lambda role: ranked.select(F.col("r").alias(f"t_{role}"), F.col("x").alias(role))
    return base.join(mem("s"), "t_s").join(mem("n"), "t_n").select("i", "c", "s", "n")


def anchor_fanout(comp_v: DataFrame, sim_v: DataFrame, neg_v: DataFrame) -> DataFrame:
    """Per anchor: bag sizes k_* and distinct sizes d_* of the three relations,
    and the tuple counts they imply (no join of the relations themselves)."""
    def counts(df, role):
        return df.groupBy(F.col("item_id_1").alias("i")).agg(
            F.count(F.lit(1)).alias(f"k_{role}"),
            F.countDistinct("item_id_2").alias(f"d_{role}"),
        )

    per = counts(comp_v, "c").join(counts(sim_v, "s"), "i").join(counts(neg_v, "n"), "i")

    def product(kind):  # a hot anchor's product of three counts passes BIGINT
        wide = [F.col(f"{kind}_{role}").cast("decimal(12,0)") for role in "csn"]
        return (wide[0] * wide[1] * wide[2]).cast("decimal(38,0)")

    return per.withColumns(
        {
            "tuples_before_dedup": product("k"),
            "tuples_train": product("d"),
            "tuples_test": F.col("d_c"),
        }
    )


def tuple_counts(fanout: DataFrame) -> DataFrame:
    """One row: tuples before dedup (the reference prints this), distinct train
    tuples, test tuples, anchors."""
    return fanout.agg(
        F.sum("tuples_before_dedup").alias("tuples_before_dedup"),
        F.sum("tuples_train").alias("tuples_train"),
        F.sum("tuples_test").alias("tuples_test"),
        F.count(F.lit(1)).alias("anchors"),
    )


def shuffle_order(tuples: DataFrame, seed: str = "0", tag: str = "order") -> Column:
    return draw_hash(seed, F.col("i"), F.col("c"), F.col("s"), F.col("n"), tag)


def shuffled_positions(tuples: DataFrame, seed: str = "0", tag: str = "order") -> DataFrame:
    """Reproducible random order (replaces orderBy(rand())): ``pos`` is the 0-based
    place of each tuple in hash order, ties broken by the ids."""
    keyed = tuples.withColumn("_h", shuffle_order(tuples, seed, tag))
    ranked = distributed_rank(keyed, ["_h", "i", "c", "s", "n"], "pos")
    return keep_ranked(ranked.drop("_h"), ranked)
