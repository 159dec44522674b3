import re

import numpy as np
import pytest

from tuplespace.llm.components import component_labels
from tuplespace.llm.minhash import RARITY_SLOTS, _meetings, _slot, estimate, near_duplicates, pack_low_bits, parity_words, minima, rare_grams
from tuplespace.llm.queries import op5_minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(i), root(j)))
            comp[q] = p
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def test_query_against_all_pairs(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op5_minhash(spark, sf_small).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies_and_edges(spark, rng, make_words):
    base = make_words(rng, 120).split()
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = make_words(rng, 1)
        rows.append((k + 10, " ".join(copy)))
    rows += [(1000 + k, make_words(rng, 30)) for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three"),
             (2006, "É a b c d"), (2007, "é a b c d"), (3, " ".join(base))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, cls string, key string")
    got = sorted(tuple(r) for r in near_duplicates(docs.repartition(5)).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e"), (None, "p q r s t"), (4, "a b c d e"), (4, "a b c d e"), (9, "A b c d e")]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 1, 4, True), (4, 1, 4, True), (9, 1, 4, False), (None, 1, 4, False), (None, 1, None, True)],
                         key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (0, 1000, 1700):
        a, b = pool[:2000], np.concatenate([pool[:shared], pool[2000:][: 2000 - shared]])
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        mins = minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        packed = pack_low_bits(mins).view(np.int64)
        df = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "a array<long>, b array<long>")
        assert df.select(estimate(df.a, df.b)).first()[0] == pytest.approx(true, abs=0.17)


def test_components_of_long_chain(spark, rng):
    n = 200
    names = list(range(n))
    rng.shuffle(names)
    links = [(names[k], names[k + 1]) for k in range(n - 1) if k != 90]
    got = dict(component_labels(spark.createDataFrame(links, "a long, b long")).collect())
    first, second = names[:91], names[91:]
    assert got == {x: min(first) for x in first} | {x: min(second) for x in second}


def test_texts_without_an_id_are_linked(spark, rng, make_words):
    from corpus_pipeline import near_dedup

    a, b, c, d, e = (make_words(rng, 60).split() for _ in range(5))
    # The first and the last 50 words of c are alike only through the whole.
    rows = [(None, a, "a"), (None, [*a[1:], "one"], "a"), (None, [*a[1:], "two"], "a"), (None, a, "a"), (5, b, "b"), (None, b[2:], "b"),
            (None, d, "d"), (8, e, "e"), (20, c[:50], "c"), (21, c[10:], "c"), (None, c, "c"), (None, [], "none"), (None, [], "none")]
    docs = spark.createDataFrame([(i, " ".join(t), k) for i, t, k in rows], "doc_id long, text string, source string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    want = [(None, None, True)] * 7 + [(5, 5, True), (None, 5, False), (8, 8, True), (20, 20, True), (21, 20, False), (None, 20, False)]
    assert got == sorted(want, key=str)
    left = near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    want = [("5", "b"), ("8", "e"), ("20", "c"), ("None", "a"), ("None", "d"), ("None", "none"), ("None", "none")]
    assert sorted((str(r.doc_id), r.source) for r in left.collect()) == sorted(want)


def test_rare_grams_of_linked_sets_meet():
    rng = np.random.default_rng(11)
    pool = rng.integers(-(1 << 62), 1 << 62, 400)
    rarity = np.zeros(RARITY_SLOTS, np.int64)
    for _ in range(300):
        whole = rng.choice(pool, rng.integers(1, 60), replace=False)
        other = whole[: -(-75 * len(whole) // 100)]  # exactly at the threshold
        np.add.at(rarity, _slot(whole), 1)
        (a, rest_a), (b, rest_b) = rare_grams(whole, rarity, 75), rare_grams(other, rarity, 75)
        shared = [min(rest_a[a == g][0], rest_b[b == g][0]) + 1 for g in set(a.tolist()) & set(b.tolist())]
        assert shared and max(shared) >= len(other)
        assert len(a) <= len(whole) - -(-75 * len(whole) // 100) + 1


def test_template_shared_by_unlike_texts(spark, rng, make_words):
    """Texts of one template under the threshold share buckets and aren't linked; pairs of near copies among them are."""
    template = make_words(rng, 90).split()
    rows = []
    for k in range(160):
        own = make_words(rng, 50).split()
        rows.append((2 * k, " ".join(template + own)))
        if k % 4 == 0:
            rows.append((2 * k + 1, " ".join(template + own[:-2] + make_words(rng, 2).split())))
    rows += [(9000 + k, " ".join(template + make_words(rng, k).split())) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs.repartition(5)).collect())
    assert got == brute(rows)


def test_template_texts_meet_on_rare_grams_only(spark, rng, make_words):
    template, count = make_words(rng, 90).split(), 60
    texts = [(k, " ".join(template + make_words(rng, 50).split())) for k in range(count)]
    rows = spark.createDataFrame([(1, bytes([k]), (False, k, b""), k > 0) for k in range(count)],
                                 "key long, cls binary, comp struct<no_id: boolean, id: long, cls: binary>, outside boolean")
    sets = spark.createDataFrame([(bytes([k]), [hash(g) for g in shingles(t)]) for k, t in texts], "cls binary, grams array<long>")
    assert _meetings(rows, sets, 75).count() == 0  # one group of 60 on its key, 1,770 pairs


def test_near_misses_are_parted_before_they_are_pairs(spark):
    """Sets of two thirds similarity share rare grams that come early; what they differ in shows in the bits of odd count."""
    rng, count = np.random.default_rng(7), 60
    pool = rng.integers(-(1 << 62), 1 << 62, 100)
    sets = [rng.choice(pool, 80, replace=False) for _ in range(count)]
    sets += [np.r_[s[1:], k] for k, s in enumerate(sets[:5])]  # 79 of 81 shared
    names = [bytes([k]) for k in range(len(sets))]
    linked = {(names[a], names[b]) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) * 100 >= 75 * len(np.union1d(sets[a], sets[b]))}
    rows = spark.createDataFrame([(1, c, (False, k, b""), k % 7 > 0) for k, c in enumerate(names)],
                                 "key long, cls binary, comp struct<no_id: boolean, id: long, cls: binary>, outside boolean")
    grams = spark.createDataFrame([(c, s.tolist()) for c, s in zip(names, sets)], "cls binary, grams array<long>")
    met = [(bytes(r.a), bytes(r.b)) for r in _meetings(rows, grams, 75).collect()]
    inside = {c for k, c in enumerate(names) if k % 7 == 0}
    wanted = {(min(p), max(p)) for p in linked if not set(p) <= inside}
    assert len(wanted) >= 5 and wanted <= set(met) and len(met) == len(set(met))
    assert len(met) < 300  # of 2,080 pairs


def test_bits_of_odd_count_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(-50, 50, rng.integers(1, 80)) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        differing = sum(int(x).bit_count() for x in (parity_words(a) ^ parity_words(b)).view(np.uint64))
        assert differing <= len(np.setxor1d(a, b)) and (differing + len(np.setxor1d(a, b))) % 2 == 0
