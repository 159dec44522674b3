"""Blocked gather of pair vectors against plain Python."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tuplespace.operators.gather import block_count, blocked_distances, dealt_pairs, wanted_items


def _plain(pairs, vecs):
    rows = Counter()
    for kind, a, b in pairs:
        for x in [v for i, v in vecs if i == a and a is not None]:
            for y in [v for i, v in vecs if i == b and b is not None]:
                fits = x is not None and y is not None and len(x) == len(y)
                d = round(math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y))), 9) if fits else None
                rows[(kind, a, b, d)] += 1
    return rows


def _spark(spark, pairs, vecs, id_type="long", **kw):
    p = spark.createDataFrame(pairs, f"kind string, item_id_1 {id_type}, item_id_2 {id_type}")
    v = spark.createDataFrame(vecs, f"item_id {id_type}, ev array<float>")
    out = blocked_distances(p, v, ["kind", "item_id_1", "item_id_2"], sqrt=True, **kw)
    return Counter((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in out.collect())


VECS = [(k, [float(k), float(k % 3), 0.5]) for k in range(30)] + [(4, [9.0, 9.0, 9.0]), (30, None), (31, [1.0]), (32, [])]
PAIRS = [("comp", k % 33, 7) for k in range(200)] + [("neg", 7, 7)] * 50 + [
    ("sim", None, 3), ("sim", 3, None), (None, 4, 4), ("comp", 30, 1), ("comp", 31, 1), ("comp", 32, 32), ("neg", 99, 1)]


def test_equal_to_plain_python_at_any_layout(spark):
    want = _plain(PAIRS, VECS)
    for blocks, cell_pairs in ((None, 65536), (1, 65536), (1, 16), (5, 65536), (5, 8)):
        assert _spark(spark, PAIRS, VECS, blocks=blocks, cell_pairs=cell_pairs) == want


def test_text_ids_and_empty_tables(spark):
    text = lambda k: None if k is None else f"B{k}"
    pairs, vecs = [(k, text(a), text(b)) for k, a, b in PAIRS], [(text(i), v) for i, v in VECS]
    assert _spark(spark, pairs, vecs, "string", blocks=3) == _plain(pairs, vecs)
    assert not _spark(spark, [], VECS) and not _spark(spark, PAIRS, [])


def test_vectors_sent_do_not_grow_with_the_pairs(spark):
    def sent(copies):
        pairs = spark.range(copies * 300).select((F.col("id") % 300).alias("a"), F.lit(7).cast("long").alias("b"))
        return wanted_items(dealt_pairs(pairs, ["a", "b"], "a", "b", 4), "a", "b").count()

    assert sent(1) == sent(20) <= 300 + 4 + 4


def test_a_hot_pair_is_parted_and_its_cells_are_even(spark):
    pairs = spark.range(4000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))
    sizes = [r["count"] for r in dealt_pairs(pairs, ["a", "b"], "a", "b", 2, 500).groupBy("_block_1", "_block_2", "_part").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) <= 700


def test_blocks_follow_the_bytes(spark):
    v = spark.range(1000).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(1.0), 100).alias("ev"))
    assert block_count(v, block_bytes=80_000) == 10 and block_count(v.limit(0)) == 1


def test_no_vector_on_a_pair_in_the_plan(spark, sf_small):
    from tuplespace.plans.job import TupleJob

    plan = TupleJob(spark, sf_small).pair_distances(blocks=4)._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and ("item_id" in line or "_item" in line)]
    assert len(joins) == 1 and "FlatMapCoGroupsInArrow" in plan  # vectors meet distinct (cell, item) rows only


def test_tuples_by_gather_equal_joins(spark, monkeypatch):
    """tuple_distance and the part distances of the train split: no vector travels with a row."""
    from tuplespace.functions.vectors import l2_scale
    from tuplespace.operators import gather, lookup

    vecs = [*VECS, (40, [0.0, 0.0, 0.0]), (41, [1.0, None, 2.0])]
    v = spark.createDataFrame(vecs, "item_id long, ev array<float>").withColumn("scale", l2_scale(F.col("ev")))
    ids = [0, 4, 7, 29, 30, 31, 32, 40, 41, 99, None]
    rows = [(ids[k % 11], ids[k * 3 % 11], ids[k * 7 % 7], 5, k % 4) for k in range(120)]
    df = spark.createDataFrame(rows, "i long, c long, s long, n long, batch_id long")
    specs = [("i", "c", "d2c"), ("i", "s", "d2s"), ("i", "n", "d2n")]
    for scale in (None, "scale"):
        for asked, keep in ((specs, df.columns), (specs[:1], ["i", "c"])):
            joined = lookup.VectorTable(v, "ev", scale).sq_distances(df, asked, keep)
            table = lookup.VectorTable(v, "ev", scale)
            table.blocks = 3
            gathered = table.sq_distances(df, asked, keep)
            assert Counter(map(str, gathered.collect())) == Counter(map(str, joined.collect()))
            plan = gathered._jdf.queryExecution().analyzed().toString()
            joins = [line for line in plan.splitlines() if "Join " in line and "_item" in line]
            assert "FlatMapCoGroupsInArrow" in plan and len(joins) == 1  # vectors meet distinct (cell, item) rows only
    monkeypatch.setattr(gather, "DENSE_PAIRS", 30)
    for blocks, cell_rows in ((2, 8), (9, 8), (2, 1000)):
        out = gather.gathered_distances(df, v, specs[:1], ["i", "c"], "ev", "scale", blocks=blocks, cell_rows=cell_rows)
        assert Counter(map(str, out.collect())) == Counter(map(str, joined.collect()))


def test_layout_sends_few_vectors(spark):
    from tuplespace.operators.gather import layout

    many = spark.range(200_000).select((F.col("id") % 20_000).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("_row"))
    k1, k2, _ = layout(many, ("a", "b"), 50)
    assert k2 == 1 and k1 <= 55  # few second items: each block of first items once, not 50 times
    sparse = many.select("a", F.xxhash64("_row").alias("b"), "_row")
    assert layout(sparse, ("a", "b"), 400, 10_000) == (20, 1, 10_000)


def test_a_given_number_of_blocks_is_the_least(spark, monkeypatch):
    from tuplespace.operators import gather

    asked = []
    plain = gather.dealt_rows
    monkeypatch.setattr(gather, "dealt_rows", lambda n, k, i, cells: asked.append(cells) or plain(n, k, i, cells))
    monkeypatch.setattr(gather, "block_count", lambda *_: 6)
    assert _spark(spark, PAIRS, VECS, blocks=4) == _plain(PAIRS, VECS) and asked[0][:2] == (6, 6)


def test_cells_of_tuples_follow_the_bytes_of_an_item(spark):
    from tuplespace.operators.gather import BLOCK_BYTES, HELD_BLOCKS, TUPLE_ROWS, tuple_rows

    assert tuple_rows(64 * 1000, 1000) == TUPLE_ROWS
    wide = tuple_rows(3072 * 1000, 1000)
    assert wide * 4 * 3072 * 8 <= 4 * HELD_BLOCKS * BLOCK_BYTES < 2 * wide * 4 * 3072 * 8 and tuple_rows(0, 0) == TUPLE_ROWS


def test_second_items_are_not_copied_to_many_cells(spark):
    """Four times the items and pairs send about four times the vectors, not more by the other side's blocks."""
    from tuplespace.operators.gather import layout

    def sent(k):
        pairs = spark.range(400_000 * k).select(
            (F.col("id") % (20_000 * k)).alias("a"), F.pmod(F.xxhash64("id"), F.lit(1000 * k)).alias("b"), F.col("id").alias("_row"))
        k1, k2, _ = layout(pairs, ("a", "b"), 4 * k)
        return 20_000 * k * k2 + 1000 * k * k1

    assert sent(4) <= 4.6 * sent(1)


def test_parts_are_written_once(spark, sf_small):
    from tuplespace.plans.job import TupleJob

    j = TupleJob(spark, sf_small)
    for part in j.parts:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_passes_give_all_pairs_and_leave_no_vectors_on_disk(spark, tmp_path, monkeypatch):
    """pair_distance_blocked goes pass by pass; the shuffle files of one pass are gone before the next."""
    from tuplespace import session
    from tuplespace.operators import gather

    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in store.getAllFiles().mkString(",").split(",") if "shuffle_" in f and ".data" in f}
    path = lambda _, name: str(tmp_path / name)
    monkeypatch.setattr(session, "scratch_path", path)
    monkeypatch.setattr(gather, "scratch_path", path)
    left, plain = [], gather._measured
    monkeypatch.setattr(gather, "_measured", lambda *a: left.append(len(files() - before)) or plain(*a))
    for id_type, text in (("long", lambda k: k), ("string", lambda k: None if k is None else f"B{k}")):
        pairs, vecs = [(k, text(x), text(y)) for k, x, y in PAIRS], [(text(i), v) for i, v in VECS]
        for at_once, many in ((1, True), (1 << 29, False)):
            monkeypatch.setattr(gather, "PASS_BYTES", at_once)
            p = spark.createDataFrame(pairs, f"kind string, item_id_1 {id_type}, item_id_2 {id_type}")
            v = spark.createDataFrame(vecs, f"item_id {id_type}, ev array<float>")
            left.clear()
            before = files()
            out = gather.distances_in_passes(p, v, ["kind", "item_id_1", "item_id_2"], "kind", sqrt=True, blocks=4)
            got = Counter((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in out.collect())
            assert got == _plain(pairs, vecs)
            assert len(left) > 3 if many else len(left) == 3  # three kinds, one of them null
            assert max(left) <= left[0] + 4 * len(left) and not (tmp_path / "gather-rows").exists()
            for folder in tmp_path.iterdir():
                session.delete_path(spark, str(folder))
    empty = spark.createDataFrame([], "kind string, item_id_1 long, item_id_2 long")
    assert gather.distances_in_passes(empty, spark.createDataFrame(VECS, "item_id long, ev array<float>"), empty.columns, "kind").count() == 0


def test_a_pass_layout_sends_few_vectors():
    from tuplespace.operators.gather import pass_layout

    for k in (1, 10):  # many pairs, few second items: far fewer vectors than pairs
        (k1, k2, _), sent = pass_layout(34_000_000 * k, 1_200_000 * k, 60_000 * k, 19 * k, 4)
        assert k1 >= 4 and k2 >= 4 and sent <= 34_000_000 * k / 4
    (k1, k2, cell), sent = pass_layout(2_000_000, 1_200_000, 1_100_000, 19, 4)  # hardly more pairs than items
    assert k1 >= 4 and k2 >= 4 and sent <= 4_000_000
