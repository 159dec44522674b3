import numpy as np
import pytest

from tuplespace.llm.onebit import CODE_BITS, estimates, nearest, pack, rotation
from tuplespace.llm.queries import op1_one_bit


def brute(rows, every=20, k=20):
    """rows: (id, vector) that take part."""
    out = []
    for q, x in rows:
        if q % every:
            continue
        scored = []
        for i, y in rows:
            if i != q:
                s = 0.0
                for a, b in zip(x, y):
                    s += float(a) * float(b)
                scored.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_query_recall_and_exact_scores(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op1_one_bit(spark, sf_small).collect())
    want = brute(rows)
    assert len(got) == len(want)
    true = {(q, i): s for q, _, i, s in brute(rows, k=len(rows))}
    assert all(s == true[q, i] for q, _, i, s in got)
    recall = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert recall >= 0.99


def test_bounds_hold_and_choose_few():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(20, size=3000)] + 0.4 * rng.normal(size=(3000, 64))
    queries = x[:100]
    mean, turn = x.mean(axis=0), rotation(64, CODE_BITS)
    np.testing.assert_allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    estimate, bound = estimates(queries, mean, turn, *pack(x, mean, turn))
    off = np.abs(estimate - queries @ x.T)
    assert (off <= bound).mean() > 0.999
    kth = np.sort(queries @ x.T, axis=1)[:, -20]
    assert ((estimate + bound >= kth[:, None]).mean()) < 0.25


def test_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(45)] + [(100 + k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(40)]
    bad = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (220, [1.0, 2.0]),
           (None, [9.0] * 5), (240, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows + bad], "vec_id long, embedding array<double>, v string, score double")
    got = sorted(tuple(r) for r in nearest(df.repartition(3)).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(rows)]
    assert [g[3] for g in got] == [w[3] for w in brute(rows)]
    assert nearest(df.where("vec_id > 900")).collect() == []
    few = sorted(tuple(r) for r in nearest(df.where("vec_id < 4")).collect())
    assert [g[:3] for g in few] == [w[:3] for w in brute(rows[:4])]
    twice = df.where("vec_id < 30").unionByName(df.where("vec_id IN (3, 20)"))
    double = nearest(twice).where("query_id = 20").collect()
    assert len(double) == 20 and sum(r.vec_id == 3 for r in double) in (0, 2) and all(r.vec_id != 20 for r in double)


def test_many_blocks_give_the_same(spark, sf_small, monkeypatch):
    from tuplespace.llm import onebit
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    one = sorted(tuple(r) for r in nearest(df).collect())
    monkeypatch.setattr(onebit, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(onebit, "QUERY_BLOCK", 7)
    many = sorted(tuple(r) for r in nearest(df).collect())
    assert len({r[:3] for r in one} ^ {r[:3] for r in many}) <= 0.02 * len(one)
    assert pytest.approx([r[3] for r in many], abs=0.2) == [r[3] for r in one]
