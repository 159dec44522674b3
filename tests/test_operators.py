"""Operators on hand-made fixtures: sampling, tuples, ranks, scoring, batching."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuplespace.operators import clean, sampling, tuples
from tuplespace.operators.batches import minibatches
from tuplespace.operators.metrics import margin_sweep
from tuplespace.operators.ranks import distributed_rank, running_totals
from tuplespace.operators.scoring import score


def _catalog(spark):
    rows = [
        ("A", '[["x","y"],["z"]]', "t\nA", "u"),
        ("B", '[["x","y"]]', "tB", "u"),
        ("C", '[["x","y"],["z"]]', "tC", "u"),
        ("D", '[["z"]]', None, "u"),  # null title: dropped
        ("E", "[[]]", "tE", "u"),  # only an empty path
        ("A", '[["x","y"],["z"]]', "t\nA", "u"),  # duplicate row: distinct
        ("F", '[["solo"]]', "tF", "u"),
    ]
    return clean.clean_catalog(spark.createDataFrame(rows, "asin string, categories string, title string, imUrl string"))


def test_clean_catalog(spark):
    cat = _catalog(spark)
    got = {r["asin"]: r["title"] for r in cat.collect()}
    assert got == {"A": "t A", "B": "tB", "C": "tC", "E": "tE", "F": "tF"}


def test_pairs_by_label(spark):
    pairs = spark.createDataFrame([("A", "B", "1"), ("A", "C", "0"), ("A", "D", "2")], "item_id_1 string, item_id_2 string, label string")
    assert clean.pairs_by_label(pairs, "1").count() == 1
    assert clean.pairs_by_label(pairs, "0").count() == 1  # label '2' belongs to neither


def test_sampling_in_path_and_reproducible(spark):
    cat = _catalog(spark)
    comp = spark.createDataFrame(
        [("A", "B"), ("A", "C"), ("A", "F"), ("Q", "A"), ("E", "A"), ("F", "A")], "item_id_1 string, item_id_2 string"
    )
    d1 = sampling.similar_draws(comp, cat).collect()
    d2 = sampling.similar_draws(comp, cat).collect()
    assert sorted(map(tuple, d1)) == sorted(map(tuple, d2))
    by = {(r["item_id_1"], r["comp_id"]): r for r in d1}
    assert ("Q", "A") not in by  # anchor not in catalog vanishes
    assert by[("E", "A")]["item_id_2"] is None  # no usable path: unresolved
    members = {'["x","y"]': {"A", "B", "C"}, '["z"]': {"A", "C"}}
    for k in [("A", "B"), ("A", "C"), ("A", "F")]:
        r = by[k]
        assert r["item_id_2"] in members[r["path"]]
    assert len(sampling.unresolved_anchors(sampling.similar_draws(comp, cat)).collect()) == 1
    no_self = sampling.similar_draws(comp, cat, exclude_self=True).collect()
    for r in no_self:
        if r["item_id_2"] is not None:
            assert r["item_id_2"] != r["item_id_1"]
    assert {(r["item_id_1"], r["item_id_2"]) for r in no_self if r["item_id_1"] == "F"} == {("F", None)}


def _relations(spark):
    comp = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("a", "c3"), ("b", "c1"), ("z", "c1")], "item_id_1 string, item_id_2 string")
    neg = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("z", "n1"), ("a", "novec")], "item_id_1 string, item_id_2 string")
    sim = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("a", "s2"), ("b", "s1"), ("z", "s1")], "item_id_1 string, item_id_2 string")
    ids = ["a", "b", "c1", "c2", "c3", "n1", "n2", "s1", "s2"]  # z has no vector, novec neither
    vecs = spark.createDataFrame([(i, [float(k), 1.0]) for k, i in enumerate(ids)], "item_id string, ev array<float>")
    return comp, neg, sim, vecs


def test_tuple_assembly(spark):
    comp, neg, sim, vecs = _relations(spark)
    comp_v, neg_v, sim_v = tuples.vector_joined(comp, neg, sim, vecs)
    C, S, N = tuples.tuple_parts(comp_v, sim_v, neg_v)
    train = {tuple(r) for r in tuples.assemble_train(C, S, N).collect()}
    # anchor b has no negative, z no vector: only a forms tuples, 3 c x 2 distinct s x 2 n
    assert len(train) == 12 and {t[0] for t in train} == {"a"}
    cv, sv, nv = comp_v.collect(), sim_v.collect(), neg_v.collect()
    brute = {(c[0], c[1], s[1], n[1]) for c in cv for s in sv for n in nv if c[0] == s[0] == n[0]}
    assert train == brute
    # a hot anchor split into cells (1 or 2 items per side) gives the same rows, each once
    for side in (1, 2):
        cells = tuples.assemble_train(C, S, N, cell_side=side).collect()
        assert len(cells) == len(brute) and {tuple(r) for r in cells} == brute
    cs = tuples.salted_product([(C, "c"), (S, "s")], cell_side=1).collect()
    assert sorted(map(tuple, cs)) == sorted(tuples.comp_sim(C, S).collect())
    counts = tuples.tuple_counts(tuples.anchor_fanout(comp_v, sim_v, neg_v)).first()
    assert counts["tuples_before_dedup"] == 3 * 3 * 2 and counts["tuples_train"] == 12
    test = tuples.assemble_test(C, S, N).collect()
    assert len(test) == 3 and len({(r["i"], r["c"]) for r in test}) == 3
    assert all(tuple(r) in train for r in test)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1000)), min_size=1, max_size=60, unique=True))
def test_distributed_rank_equals_sorted_rank(spark, rows):
    df = spark.createDataFrame(rows, "g long, x long")
    got = {(r["g"], r["x"]): r["grank"] for r in distributed_rank(df, ["g", "x"], num_partitions=3).collect()}
    exp = {k: i for i, k in enumerate(sorted(rows))}
    assert got == exp


def test_running_totals(spark):
    df = spark.createDataFrame([(b, b * 2) for b in range(25)], "batch_id long, v long")
    got = {r["batch_id"]: r["v_cum"] for r in running_totals(df, "batch_id", ["v"]).collect()}
    assert got == {b: sum(2 * k for k in range(b + 1)) for b in range(25)}


def test_strict_margins(spark):
    ms, mc, mn = 1.0, 2.0, 3.0
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 0.5, 2.0), (1.5, 1.0, 2.5)], "d2c double, d2s double, d2n double")
    rows = score(df, (ms, mc, mn)).collect()
    # d2c exactly on ms / mc: comp prediction false (strict); d2s == ms: sim false
    assert [r["pred_comp"] for r in rows] == [False, False, True]
    assert [r["pred_sim"] for r in rows] == [False, True, False]
    assert [r["pred_neg"] for r in rows] == [True, False, True]  # compared with mc, not mn
    assert rows[0]["loss"] == pytest.approx(1.0 + 0 + 0 + 0)
    assert all(r["loss"] >= 0 for r in rows)
    sw = margin_sweep(df, [(ms, mc, mn)]).first()
    assert sw["precision"] == pytest.approx(sw["acc_comp"])  # the degenerate ratio


@pytest.mark.parametrize("n,b,expect", [(5, 8, 0), (16, 8, 2), (17, 8, 2)])
def test_minibatches_drop_remainder(spark, n, b, expect):
    t = spark.createDataFrame([(f"i{k}", "c", "s", "n") for k in range(n)], "i string, c string, s string, n string")
    mb = minibatches(t, b)
    assert mb.select("batch_id").distinct().count() == expect
    assert mb.count() == expect * b
    keep = minibatches(t, b, drop_remainder=False)
    assert keep.count() == n


def test_minibatches_epoch_reshuffles(spark):
    t = spark.createDataFrame([(f"i{k}", "c", "s", "n") for k in range(64)], "i string, c string, s string, n string")
    e0 = {r["i"]: r["pos"] for r in minibatches(t, 8, epoch=0).collect()}
    e1 = {r["i"]: r["pos"] for r in minibatches(t, 8, epoch=1).collect()}
    assert sorted(e0.values()) == list(range(64)) and e0 != e1


def test_vector_table_distances(spark):
    from tuplespace.operators.lookup import VectorTable

    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 1.0]), ("c", [0.0, 0.0])], "item_id string, ev array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zz")], "x string, y string")
    vt = VectorTable(vecs)
    got = {(r["x"], r["y"]): r["d2"] for r in vt.sq_distances(pairs, [("x", "y", "d2")], ["x", "y"]).collect()}
    assert got == {("a", "b"): 5.0, ("a", "c"): 5.0}


def test_hot_anchor_product_is_whole(spark):
    """One anchor with 300 complementary items is cut into 3 cells on that axis; the
    product still has every (c, s, n) exactly once, next to an ordinary anchor."""
    C = spark.createDataFrame([("h", f"c{k}") for k in range(300)] + [("o", "c0")], "i string, c string")
    S = spark.createDataFrame([("h", "s0"), ("h", "s1"), ("h", "s2"), ("o", "s0")], "i string, s string")
    N = spark.createDataFrame([("h", "n0"), ("h", "n1"), ("o", "n0")], "i string, n string")
    got = [tuple(r) for r in tuples.assemble_train(C, S, N).collect()]
    cs, ss, ns = C.collect(), S.collect(), N.collect()
    brute = {(i, c, s, n) for i, c in cs for j, s in ss for k, n in ns if i == j == k}
    assert len(got) == len(brute) == 300 * 3 * 2 + 1 and set(got) == brute


def test_binned_density_keeps_its_bound(spark):
    import numpy as np

    from tuplespace.operators.density import density_binned, density_grid

    rng = np.random.default_rng(2)
    rows = [(kind, float(d), int(w)) for kind, at in (("a", 1.0), ("b", 5.0)) for d, w in zip(
        rng.normal(at, 0.3, 400), rng.integers(1, 9, 400), strict=True)]
    samples = spark.createDataFrame(rows, "kind string, d double, w long")
    exact = {(r.kind, r.k): r for r in density_grid(samples, weight="w").collect()}
    for fine in (1, 4, 16):
        got = density_binned(samples, weight="w", fine=fine).collect()
        assert {(r.kind, r.k) for r in got} == exact.keys()
        worst = max(abs(r.density - exact[r.kind, r.k].density) / r.bound for r in got)
        assert 0.01 < worst <= 1.0 + 1e-9
        assert all(abs(r.g - exact[r.kind, r.k].g) < 1e-9 for r in got)


def test_ragged_and_null_vectors_keep_the_others(spark):
    from tuplespace.functions.vectors import with_sq_distances

    rows = [(1, [1.0, 2.0], [0.0, 0.0]), (2, None, [1.0]), (3, [1.0], [1.0, 2.0]), (4, [3.0], [1.0]), (5, [], []), (6, [2.0, 2.0], [2.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>").coalesce(1)
    got = {r.k: r.d for r in with_sq_distances(df, [("a", "b", "d")], ["k"]).collect()}
    assert got == {1: 5.0, 2: None, 3: None, 4: 4.0, 5: 0.0, 6: 4.0}


def test_rows_per_kind_are_broadcast(spark):
    """No sample is dealt by its kind, of which there are a few, whatever the session broadcasts by itself."""
    from tuplespace.operators.density import density_binned, density_grid, histogram

    samples = spark.createDataFrame([("ab"[k % 2], float(k), k % 3 + 1) for k in range(40)], "kind string, d double, w long")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (density_binned, density_grid, histogram):
            found = report(samples, weight="w")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert {r["kind"] for r in found.collect()} == {"a", "b"}
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_margin_reads_the_sweep_once(spark):
    from tuplespace.operators.metrics import best_margin

    schema = "margin_id int, ms double, mc double, mn double, acc_rank double"
    rows = [(0, 1.0, 2.0, 3.0, None), (2, 1.2, 2.2, 3.2, 0.5), (1, 1.1, 2.1, 3.1, 0.5)]
    best = best_margin(spark.createDataFrame(rows, schema))
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert best.columns == ["margin_id", "best_acc_rank", "ms", "mc", "mn"]
    assert [tuple(r) for r in best.collect()] == [(1, 0.5, 1.1, 2.1, 3.1)]
    assert [tuple(r) for r in best_margin(spark.createDataFrame(rows[:1], schema)).collect()] == [(0, None, 1.0, 2.0, 3.0)]
    assert best_margin(spark.createDataFrame([], schema)).collect() == []


def test_tasks_of_a_product_follow_its_rows(spark, monkeypatch):
    """parts of few bytes that make many rows aren't left to one task."""
    monkeypatch.setattr(tuples, "PRODUCT_ROWS", 500)
    part = lambda r, n: spark.range(50 * n).select((F.col("id") % 50).alias("i"), F.col("id").alias(r))
    made = tuples.assemble_train(part("c", 6), part("s", 5), part("n", 7))
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 50 * 210 and len(per_task) > 10 and max(per_task) <= 8 * 500
    none = tuples.assemble_train(part("c", 0), part("s", 5), part("n", 7))
    assert none.count() == 0
