import hashlib
import re
import zlib

import numpy as np
import pytest

from tuplespace.llm.periodic import (
    collapse_runs, fragments, least_length, octaves, periodic_runs, plain_order, planted_order, stretches, z_function,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every period by comparing words q apart; runs of a smaller period are left out."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out)


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rows_of(df):
    out = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
           for r in df.collect()]
    return sorted(out, key=repr)


def samples(seed=3):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "b " * 1, "a b " * 4, "a b " * 3 + "a", "x y " * 9, "A a " * 6]
    for _ in range(120):
        words = [str(w) for w in rng.integers(0, rng.integers(1, 40), rng.integers(1, 60))]
        for _ in range(rng.integers(0, 3)):
            at, unit = rng.integers(0, len(words) + 1), [str(w) for w in rng.integers(0, 5, rng.integers(1, 9))]
            words[at:at] = (unit * 9)[: int(rng.integers(len(unit), 9 * len(unit)))]
        texts.append(" ".join(words))
    return texts


def test_z_function():
    assert z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]


def test_fragments_are_whole_runs_of_one_unit():
    rng = np.random.default_rng(1)
    for n in (1, 5, 7, 40, 300):
        for letters in (1, 2, 3):
            words = rng.integers(0, letters, n)
            codes = (words.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
            found = fragments(codes, np.array([0]), np.array([n]), np.array([0]), np.array([n]), octaves(n))
            runs = sorted((a, b - a, q) for _, q, a, b in found.tolist() if b - a >= least_length(q))
            assert runs == plain_runs(words.tolist())


@pytest.mark.parametrize("group", [1 << 16, 16, 32])
def test_equals_brute_force(spark, group):
    rows = [(k, t) for k, t in enumerate(samples())] + [(None, "a b " * 8), (2, "q " * 9), (2, "q " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, period string, runs int")
    found = rows_of(collapse_runs(docs.repartition(5), group=group))
    assert found == sorted((plain_row(*r) for r in rows), key=repr)


def test_long_text_in_stretches(spark):
    rng = np.random.default_rng(5)
    unit = [f"w{k}" for k in rng.integers(0, 900, 700)]
    words = [f"v{k}" for k in rng.integers(0, 900, 1500)] + unit * 5 + unit[:13] + ["z"] * 3000 + ["u", "v", "w"] * 400
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    found = sorted(tuple(r)[2:] for r in periodic_runs(docs, plain_order, group=256).collect())
    assert found == [(1500, 3513, 700), (5013, 3000, 1), (8013, 1200, 3)]
    widths = [len(s[-1]) // 8 for s in stretches(np.zeros(20_000, np.uint64), 256)]
    assert len(widths) > 80 and max(widths) <= 20_000


def test_planted_order():
    n = 50
    for doc_id in range(60):
        h = zlib.crc32(str(doc_id).encode())
        assert (planted_order(doc_id, n) != np.arange(n)).any() <= (h % 10 == 0)


def test_empty_table(spark):
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_small):
    from tuplespace.llm.queries import op12_periodic_runs

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    some = {r.doc_id: plain_row(*r) for r in docs}
    found = {r[0]: r for r in rows_of(op12_periodic_runs(spark, sf_small))}
    assert len(found) == len(docs)
    assert {k: found[k] for k in some} == some
    assert sum(r[1] > 0 for r in found.values()) >= 10
