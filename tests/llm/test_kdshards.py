import math
import zlib
from collections import Counter, defaultdict

from tuplespace.llm.kdshards import SHARDS, TOLERANCE, kd_shards, points, shard_report
from tuplespace.llm.queries import op3_kd_shards
from tuplespace.session import cut_lineage


def check(got, rows, shards):
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, bytes_ = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return bytes_


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = op3_kd_shards(spark, sf_small).collect()
    bytes_ = check(got, [tuple(r) for r in docs.collect()], SHARDS)
    mean, largest = sum(bytes_.values()) / SHARDS, max(r.size for r in got)
    assert all(abs(bytes_[s] - mean) <= 0.01 * mean + largest for s in range(SHARDS))


def test_bytes_are_near_equal_with_hot_copies(spark, rng, make_words):
    rows = [(k, make_words(rng, rng.randint(1, 40)), rng.choice(["en", "de", None])) for k in range(1500)]
    rows += [(5000 + k, "the same text " * 8, "en") for k in range(900)] + [(9000, None, "en"), (9001, "", "en"), (None, "x", "fr")]
    rows += [(7, "repeated row", "en")] * 300
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lang string, row string, size int")
    got = shard_report(docs.repartition(5), 13).collect()
    bytes_ = check(got, [r[:2] for r in rows], 13)
    mean = sum(bytes_.values()) / 13
    assert len(bytes_) == 13 and max(abs(b / mean - 1) for b in bytes_.values()) < 0.02
    # Copies that fit stay together: a light group of equal texts is in one shard.
    light = [(k, "light " + make_words(rng, 3), "en") for k in range(30)] * 4
    mixed = spark.createDataFrame(rows + light, "doc_id long, text string, lang string")
    homes = defaultdict(set)
    for r in shard_report(mixed, 13).collect():
        homes[r.text_crc32].add(r.shard)
    split = [c for c in {zlib.crc32(t.encode()) for _, t, _ in light} if len(homes[c]) > 1]
    assert len(split) <= 12


def test_few_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "bb" * 50000, "de")], "doc_id long, text string, lang string")
    check(shard_report(docs, 5).collect(), [(1, "a"), (2, "bb" * 50000)], 5)
    assert shard_report(docs.where("doc_id > 5"), 5).collect() == []
    assert [r.slot for r in shard_report(docs, 1).orderBy("slot").collect()] == [0, 1]


def test_first_cut_is_the_weighted_median(spark, rng):
    docs = spark.createDataFrame([(k, "x" * rng.randint(1, 500), "en") for k in range(800)], "doc_id long, text string, lang string")
    by_shard = dict(kd_shards(docs, 2).groupBy("shard").agg({"size": "sum"}).collect())
    assert abs(by_shard[0] / sum(by_shard.values()) - 0.5) < 0.01


def plain_tree(rows, shards):
    """shard by row, from the rows' size, bins and hashes, all in plain Python."""
    slack = max(TOLERANCE * sum(r.size for r in rows) / shards, 1.0)

    def weigh(keys):
        out = {}
        for key, r in zip(keys, rows, strict=True):
            total, n = out.get(key, (0, 0))
            out[key] = total + r.size, n + 1
        return out

    def parted(keys, hashes):
        found = weigh(keys)
        parts = {k: math.ceil(b * 2 / slack) for k, (b, n) in found.items() if b > slack and n > 1}
        return [(*k, h % parts[k] if k in parts else 0) for k, h in zip(keys, hashes, strict=True)], parts

    cells = [(r.size_bin, r.script_bin, r.sum_bin) for r in rows]
    keys, heavy = parted(cells, [r.text_hash for r in rows])
    found = weigh(keys)
    hot = {k: math.ceil(b * 2 / slack) for k, (b, n) in found.items() if k[:3] in heavy and b > slack and n > 1}
    keys = [(*k, r.row_hash % hot[k] if k in hot else 0) for k, r in zip(keys, rows, strict=True)]
    units = {k: b for k, (b, _) in weigh(keys).items()}
    spread = [max(max(k[d] for k in units) - min(k[d] for k in units), 1) for d in range(3)]
    leaf = {}

    def grow(own, first, leaves):
        if leaves == 1 or not own:
            leaf.update(dict.fromkeys(own, first))
            return
        widths = [(max(k[d] for k in own) - min(k[d] for k in own)) / spread[d] for d in range(3)]
        wide = widths.index(max(widths))
        half, total, upto, left, right = leaves // 2, sum(units[k] for k in own), 0, [], []
        for k in sorted(own, key=lambda k: (k[wide], k)):
            upto += units[k]
            (left if upto - units[k] / 2 < total * half / leaves else right).append(k)
        grow(left, first, half)
        grow(right, first + half, leaves - half)

    grow(list(units), 0, shards)
    return [leaf[k] for k in keys]


def test_equals_a_plain_tree(spark, rng, make_words):
    rows = [(k, make_words(rng, rng.randint(1, 60)) + rng.choice(["", " é" * 9, " ü ß"])) for k in range(700)]
    rows += [(2000 + k, "hot copy " * 20) for k in range(400)] + [(None, None), (3, "")]
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-docs")
    known = points(docs).collect()
    for shards in (1, 7, 16):
        want = sorted((str(r.doc_id), r.text_crc32, s) for r, s in zip(known, plain_tree(known, shards), strict=True))
        assert sorted((str(r.doc_id), r.text_crc32, r.shard) for r in kd_shards(docs, shards).collect()) == want


def test_equal_texts_of_several_languages_stay_together(spark, rng, make_words):
    texts = [make_words(rng, rng.randint(3, 30)) for _ in range(300)]
    docs = spark.createDataFrame([(2 * k + j, t, lang) for k, t in enumerate(texts) for j, lang in enumerate(("en", "de"))],
                                 "doc_id long, text string, lang string")
    homes = defaultdict(set)
    for r in shard_report(docs, 5).collect():
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 8  # only those a cut runs through
