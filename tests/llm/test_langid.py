import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tuplespace.llm.langid import (
    FEATURES, document_frequencies, fit_temperature, ftrl_pass, gram_counts, identify_languages, leader_weights, softmax)
from tuplespace.llm.queries import op2_langid


def test_query_accuracy_on_held_out_rows(spark, sf_small):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = op2_langid(spark, sf_small).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F
    from tuplespace.llm.langid import fold
    spoilt = docs.withColumn("lang", F.when(fold(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(tuple(r) for r in identify_languages(d).collect()) for d in (docs, spoilt))
    assert a == b


def test_edges(spark):
    rows = [(k, "the cat and the dog of them", "en") for k in range(40)] + [(100 + k, "der hund und die katze", "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 !? 3", "en"), (None, "the dog", "en"), (203, "und die " * 30000, None),
             (204, "é", None), (1, "the cat and the dog of them", "en")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and by[200].score == 0
    assert by[203].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out is False
    assert by[204].lang_pred in ("en", "de")


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify_languages(docs).collect()] == [("und", 0.0)]
    assert identify_languages(docs.where("doc_id < 0")).collect() == []


def test_counts_cover_whole_texts():
    text = "Ab, cä" * 5000
    (found, counts), nothing = gram_counts([text, "42"])
    plain = re.sub(r"[^a-zä]", " ", text.lower())
    grams = Counter(plain[k:k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1))
    assert nothing is None and counts.sum() == sum(grams.values()) and sorted(counts) == sorted(grams.values())


def test_document_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame([("ab",), ("ab ab",), ("b",), ("7",)], "text string").repartition(3)
    seen, total = document_frequencies(docs)
    (columns, _), = gram_counts(["b"])
    assert total == 3 and seen[columns].tolist() == [3]


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        label = int(rng.integers(2))
        columns = np.unique(np.r_[label, rng.integers(2, 200, 5)])
        rows.append((columns, np.full(len(columns), len(columns) ** -0.5), label))
    states = {}
    for l1 in (0.0, 3.0):
        z, n = np.zeros((200, 2)), np.zeros((200, 2))
        ftrl_pass(rows, z, n, 0.5, 1.0, l1, 1e-3)
        states[l1] = leader_weights(z, n, l1=l1)
    assert (states[3.0] == 0).sum() > (states[0.0] == 0).sum() and states[3.0][0, 0] > 0 > states[3.0][0, 1]


def test_temperature_recovers_scale():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(20000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.1)
    assert FEATURES & (FEATURES - 1) == 0


def test_rare_language_has_its_own_sample(spark, rng):
    """One in 150 rows; a sample of 130 over all languages would hold hardly one of them."""
    from tuplespace.llm.langid import train_language_model

    rows = [(k, " ".join(rng.choices(["the", "cat", "and", "dog", "of", "them"], k=9)), "en") for k in range(9000)]
    rows += [(20000 + k, " ".join(rng.choices(["zxq", "qwxz", "xxq", "zqz"], k=9)), "qq") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = train_language_model(docs, 100, 30).predict(docs).collect()
    assert all(r.lang_pred == r.lang for r in got)


def plain_fit(rows, shard_of, order_of):
    """TF-IDF and FTRL with dictionaries of single numbers: weights by (column, language)."""
    import math

    from tuplespace.llm.langid import ALPHA, BETA, EPOCHS, L1, L2, SHARDS

    found = {k: [dict(zip(*(x.tolist() for x in g), strict=True)) for g in gram_counts([t])][0] for k, t, _ in rows}
    langs = sorted({lang for *_, lang in rows})
    df = Counter(c for g in found.values() for c in g)
    idf = {c: math.log((1 + len(rows)) / (1 + n)) + 1 for c, n in df.items()}
    vector = {}
    for k, g in found.items():
        v = {c: (1 + math.log(n)) * idf[c] for c, n in g.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vector[k] = {c: x / size for c, x in v.items()}
    z, n = Counter(), Counter()

    def weight(z, n, key):
        if abs(z[key]) <= L1:
            return 0.0
        return -math.copysign(abs(z[key]) - L1, z[key]) / ((BETA + math.sqrt(n[key])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        states = []
        for shard in range(SHARDS):
            zs, ns = Counter(z), Counter(n)
            own = sorted((r for r in rows if shard_of[r[0]] == shard), key=lambda r: order_of(r[0], epoch))
            for k, _, lang in own:
                old = {(c, j): weight(zs, ns, (c, j)) for c in vector[k] for j in range(len(langs))}
                logit = [sum(x * old[c, j] for c, x in vector[k].items()) for j in range(len(langs))]
                top = max(logit)
                e = [math.exp(x - top) for x in logit]
                for c, x in vector[k].items():
                    for j in range(len(langs)):
                        g = x * (e[j] / sum(e) - (langs[j] == lang))
                        grown = ns[c, j] + g * g
                        zs[c, j] += g - (math.sqrt(grown) - math.sqrt(ns[c, j])) / ALPHA * old[c, j]
                        ns[c, j] = grown
            if own:
                states.append((zs, ns))
        keys = {k for zs, _ in states for k in zs}
        z = Counter({k: sum(zs[k] for zs, _ in states) / len(states) for k in keys})
        n = Counter({k: sum(ns[k] for _, ns in states) / len(states) for k in keys})
    return langs, {k: weight(z, n, k) for k in z}


def test_weights_equal_a_plain_fit(spark, rng):
    from pyspark.sql import functions as F
    from tuplespace.llm.common import mix64
    from tuplespace.llm.langid import CALIBRATION, SAMPLE, SHARDS, train_language_model

    words = {"en": ["the", "cat", "dog"], "de": ["der", "hund", "und"], "fr": ["le", "chat", "et"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 4))), lang) for k, lang in ((k, rng.choice(list(words))) for k in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(docs)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SAMPLE + CALIBRATION))
    parts = dict(docs.select("doc_id", part).collect())
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    shard_of = {k: -1 if p >= SAMPLE else p % SHARDS for k, p in parts.items()}
    langs, want = plain_fit(train, shard_of, lambda k, e: int(mix64(np.array([k + e], np.uint64))[0]))
    assert model.languages == langs
    got = np.zeros_like(model.weights)
    for (c, j), w in want.items():
        got[c, j] = w
    assert np.allclose(got, model.weights, atol=1e-9)
