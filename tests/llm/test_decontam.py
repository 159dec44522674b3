import numpy as np
import pyarrow as pa
import pytest

from tuplespace.llm.decontam import ItemIndex, contaminated, decontaminate, question_and_answer, text_words
from tuplespace.llm.queries import op7_decontam


def plain(text):
    return " " + " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split()) + " "


def test_query_finds_all_verbatim_items_only(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in op7_decontam(spark, sf_small).collect()}
    assert want and got == want


def brute_scores(index, bags, words):
    """BM25 by the formula, divided by each unit's own score."""
    n, mean = len(bags), np.mean([len(b) for b in bags])
    df = {t: sum(t in set(b) for b in bags) for b in bags for t in b}
    def score(terms, bag):
        total = 0.0
        for t in set(terms) & set(bag):
            tf = bag.count(t)
            total += np.log(1 + (n - df[t] + .5) / (df[t] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(bag) / mean))
        return total
    return [score(words, b) / score(b, b) for b in bags]


def test_pruned_search_equals_brute_force(rng, make_words):
    vocabulary = make_words(rng, 60).split()
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 20))) for _ in range(150)]
    index = ItemIndex(list(enumerate(items)))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(40)] + ["", None]
    words, documents = text_words(pa.array(texts))
    bags = [text_words(pa.array([t]))[0].tolist() for t in items]
    found = {(b, e, u): s for b, e, u, s in index.search(words, documents, 0.4)}
    passages = {}
    for d in set(documents.tolist()):
        first, last = np.flatnonzero(documents == d)[[0, -1]]
        starts = list(range(first, last + 1, index.unit_words))
        for k in starts[: max(1, len(starts) - 1)]:
            passages[int(k), int(min(k + 2 * index.unit_words, last + 1))] = d
    want = {}
    for b, e in passages:
        for u, s in enumerate(brute_scores(index, bags, words[b:e].tolist())):
            if s >= 0.4:
                want[b, e, u] = s
    assert want and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_question_and_answer():
    assert question_and_answer("What is it? It is a cat.") == ("What is it?", " It is a cat.")
    assert question_and_answer("one sentence only") == ("one sentence only", "")


def test_edges_and_parts(spark, rng, make_words):
    q, a = make_words(rng, 20) + "?", make_words(rng, 6) + "."
    long_item = make_words(rng, 300)
    noise = [make_words(rng, 400) for _ in range(4)]
    bench = spark.createDataFrame([(1, f"{q} {a}"), (2, None), (3, ""), (4, "too short"), (5, long_item), (5, long_item)],
                                  "item_id long, text string")
    rows = [(1, f"{noise[0]} {q.upper()}\n\n{a} {noise[1]}"), (2, f"{noise[0]} {q} {noise[1]}"), (3, f"{a} {noise[2]}"),
            (4, None), (5, ""), (None, f"{q} {a}"), (7, f"{noise[3]} {long_item}"), (8, noise[2]), (9, "too short"),
            (1, f"{q} {a}"), (10, f"{' '.join(noise) * 20} {q} {a} {noise[0]}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1), (None, 1), (7, 5), (9, 4), (10, 1)}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 8]
    assert contaminated(docs, bench.where("item_id > 9")).collect() == []
    assert contaminated(docs.where("doc_id > 99"), bench).collect() == []


def test_short_items_are_found_as_a_whole(spark, rng, make_words):
    bench = spark.createDataFrame([(1, "Kilo, lima mike"), (2, "papa"), (3, " .?! ")], "item_id long, text string")
    noise = make_words(rng, 300)
    rows = [(1, f"{noise} kilo LIMA mike."), (2, "kilo mike lima"), (3, "lima mike"), (4, f"Papa {noise}"), (5, noise), (6, "papa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(1, 1), (4, 2), (6, 2)}


def test_one_index_shard_at_a_time(spark, sf_small, monkeypatch):
    from tuplespace.llm import decontam
    docs, bench = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    sizes, make = [], decontam.ItemIndex
    monkeypatch.setattr(decontam, "ItemIndex", lambda items: sizes.append(len(items)) or make(items))
    monkeypatch.setattr(decontam.index_shards, "__defaults__", (40,))
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == whole
    assert len(sizes) >= 3 and sum(sizes) == bench.distinct().count()


def test_several_index_shards_give_the_same(spark, sf_small, monkeypatch):
    from tuplespace.llm import decontam
    docs, bench = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    shards = list(decontam.index_shards(bench, 16))
    assert len(shards) > 2
    monkeypatch.setattr(decontam, "index_shards", lambda b: shards)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == whole


def test_long_items_are_judged_as_a_whole(spark, rng, make_words):
    phrase = "in the light of all"
    def item(question, tail):
        return f"{make_words(rng, question)}. {tail}"
    tailed = item(128, phrase)  # 133 words, the last five common
    answered = item(128, make_words(rng, 3))  # a tail under five words
    longer = item(300, make_words(rng, 10))
    noise = [make_words(rng, 300) for _ in range(3)]
    words = longer.split()
    pieces = f" {noise[1]} ".join(" ".join(words[k:k + 155]) for k in (0, 155))
    bench = spark.createDataFrame(list(enumerate([tailed, answered, longer], 1)), "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"{noise[0]} {phrase} {noise[1]}"), (2, f"{noise[0]} {tailed} {noise[1]}"), (3, f"{tailed.split('.')[0]} {noise[2]}"),
         (4, f"{noise[1]} {answered}"), (5, f"{noise[1]} {answered.split('.')[0]} {noise[0]}"), (6, f"{noise[2]} {longer} {noise[0]}"),
         (7, " ".join(words[:300])), (8, " ".join(words[60:200])), (9, f"{noise[0]} {pieces} {noise[2]}"),
         (10, f"{noise[0]} {' '.join(words[40:])}"), (11, " ".join(words[128:]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(2, 1), (4, 2), (6, 3), (9, 3), (10, 3)}
