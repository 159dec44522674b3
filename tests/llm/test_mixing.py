import itertools
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tuplespace.llm.mixing import fit_lengths, mix, mix_report
from tuplespace.llm.queries import op10_mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(2 * sizes[s] for s in stopped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= over


def check(rows, texts):
    size = {i: len((t or "").encode().split()) for i, s, t in texts}
    source = {i: s for i, s, t in texts}
    sizes = Counter()
    for i, s, _ in texts:
        sizes[s] += size[i]
    targets = plain_targets(sizes)
    taken = Counter()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    return taken, targets


def test_query(spark, sf_small):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = op10_mixing(spark, sf_small).collect()
    taken, targets = check(rows, texts)
    assert all(abs(taken[s] - targets[s]) <= 0.02 * targets[s] for s in targets)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op10_mixing(spark, sf_small).collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), max_size=5), st.integers(0, 60))
def test_fit_is_the_best_subset(pairs, budget):
    counts = Counter()
    for length, n in pairs:
        counts[length] += n
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(x)] for x in lengths], np.int64)
    taken = fit_lengths(lengths, n, budget)
    assert (taken >= 0).all() and (taken <= n).all()
    best = max((t for picks in itertools.product(*[range(c + 1) for c in n]) if (t := sum(p * x for p, x in zip(picks, lengths))) <= budget),
               default=0)
    assert int(taken @ lengths) == best


def test_fit_large_budget_is_exact():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 1000, len(lengths))
    budget = int(lengths @ counts) * 2 // 7
    assert int(fit_lengths(lengths, counts, budget) @ lengths) == budget


def test_edges(spark):
    rows = [(k, "a", "w " * (k % 7)) for k in range(60)] + [(100, None, "x y z"), (101, "b", None), (102, "b", ""), (103, "c", "q " * 20000),
            (None, "a", "one two"), (104, "Ä", "p q")]
    docs = spark.createDataFrame([(i, s, t, 5, 6) for i, s, t in rows], "doc_id long, source string, text string, size int, target int")
    got = mix_report(docs.repartition(4)).collect()
    by_source = defaultdict(int)
    for r in got:
        by_source[r.doc_id] += r.taken
    assert len(got) == len(rows) and by_source[101] == by_source[102] == 0
    assert mix_report(docs.where("doc_id > 999")).collect() == []
    check([r for r in mix_report(docs.where("doc_id IS NOT NULL")).collect()], [r for r in rows if r[0] is not None])


def test_mix_emits_what_the_report_says_also_for_repeated_rows(spark):
    rows = [(k, "ab"[k % 2], "w " * (k % 5 + 1)) for k in range(30)] + [(7, "b", "r s t")] * 6 + [(7, "a", "r s t")] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, rank string")
    report = Counter()
    for r in mix_report(docs).collect():
        report[r.doc_id, r.size] += r.taken
    mixed = Counter()
    out = mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        n = len(r.text.split())
        mixed[r.doc_id, n] += n
    assert +mixed == +report
