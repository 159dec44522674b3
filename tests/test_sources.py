"""Text/binary connectors and sinks on hand-made files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuplespace.sinks.text import write_text
from tuplespace.sources import text as src


def test_catalog_json(spark, tmp_path):
    p = tmp_path / "cat.json"
    p.write_text('{"asin":"A","categories":"[[\\"x\\"]]","title":"t","imUrl":"u","price":"1"}\n{"asin":"B"}\n')
    df = src.read_catalog(spark, str(p))
    assert df.columns == ["asin", "categories", "title", "imUrl"] and df.count() == 2


def test_pairs_split(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "test").mkdir()
    (tmp_path / "train" / "p.txt").write_text("a\tb\t1\na\tc\t0\n")
    (tmp_path / "test" / "p.txt").write_text("x\ty\t2\n")
    assert src.read_pairs(spark, str(tmp_path), "train").count() == 2
    assert src.read_pairs(spark, str(tmp_path), "test").first()["label"] == "2"


def test_vectors_text_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("b'B00X'", [1.0, 2.0]), ("b'b1'", [3e-05])], "item_id string, ev array<double>")
    write_text(df, str(tmp_path / "v"))
    back = {r["item_id"]: r["ev"] for r in src.read_vectors_text(spark, str(tmp_path / "v")).collect()}
    assert back == {"B00X": [1.0, 2.0], "1": [3e-05]}


def test_quads_strict_and_lenient(spark, tmp_path):
    (tmp_path / "q.txt").write_text("0\x011\x012\x013\x014\n0\x01x\x012\x013\x014\n")
    lenient = src.read_quads(spark, str(tmp_path / "q.txt"), strict=False).collect()
    assert lenient[0]["i"] == 1 and lenient[1]["i"] is None
    with pytest.raises(Exception):
        src.read_quads(spark, str(tmp_path / "q.txt"), strict=True).collect()


def test_vectors_wide_and_catalog_vectors(spark, tmp_path):
    (tmp_path / "w.txt").write_text("z\x011.5\x012.5\x01ID9\n")
    r = src.read_vectors_wide(spark, str(tmp_path / "w.txt"), dim=2).first()
    assert r["item_id"] == "ID9" and r["ev"] == [1.5, 2.5]
    fields = ["id1", "sd", "d", "c", "sc", 't"q', "pt", "room", "9.5", "[0.5, 1.5]"]
    (tmp_path / "cv.txt").write_text("\x01".join(fields) + "\n")
    row = src.read_catalog_vectors(spark, str(tmp_path / "cv.txt")).first()
    assert row["title"] == 't"q' and row["ev"] == [0.5, 1.5]


def test_text_sink_no_quotes(spark, tmp_path):
    df = spark.createDataFrame([('t"q', ""), ("a", "b")], "x string, y string")
    write_text(df, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert 't"q\x01\n' in text or 't"q\x01' in text


def test_read_dir_first(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text(f"line{k}\n")
    assert src.read_dir(spark, str(tmp_path), "all").count() == 3
    assert [r[0] for r in src.read_dir(spark, str(tmp_path), "first").collect()] == ["line0"]


def test_binary_image_vectors_and_join(spark, tmp_path):
    from tuplespace.sources.binary import image_catalog, read_image_vectors

    dim = 4
    recs = b"".join(f"{i:<10}".encode()[:10] + np.arange(dim, dtype="<f4").tobytes() * 1 for i in ["A1", "B2", "C3"])
    (tmp_path / "img.b").write_bytes(recs)
    iv = read_image_vectors(spark, str(tmp_path / "img.b"), dim=dim)
    rows = {r["asin"].strip(): r["iev"] for r in iv.collect()}
    assert rows["B2"] == [0.0, 1.0, 2.0, 3.0]
    cat = spark.createDataFrame([("A1        ", "[]", "t", "u")], "asin string, categories string, title string, imUrl string")
    assert image_catalog(iv, cat).count() == 1


def test_binary_records_in_splits(spark, tmp_path):
    from tuplespace.sources.binary import read_image_vectors, write_image_vectors

    rows = [(f"id{k}", [float(k), -0.5, 3.25]) for k in range(101)]
    df = spark.createDataFrame(rows, "asin string, iev array<double>").repartition(4)
    path = str(tmp_path / "records")
    write_image_vectors(df, path, 3)
    assert not (tmp_path / "records" / "_temporary").exists()
    back = read_image_vectors(spark, path, 3, split_bytes=220)  # ten records
    assert back.rdd.getNumPartitions() >= 11
    assert sorted((r.asin.strip(), list(r.iev)) for r in back.collect()) == sorted(rows)
    ids = read_image_vectors(spark, path, 3, ["asin"])
    assert ids.columns == ["asin"] and sorted(r.asin.strip() for r in ids.collect()) == sorted(i for i, _ in rows)
    write_image_vectors(df.limit(7), path, 3)  # in place of the former
    assert read_image_vectors(spark, path, 3).count() == 7
    write_image_vectors(df.limit(7), path, 3, "append")
    assert read_image_vectors(spark, path, 3).count() == 14
    write_image_vectors(df.where("false"), path, 3)
    assert read_image_vectors(spark, path, 3).collect() == []


def test_binary_records_refuse_what_does_not_fit(spark, tmp_path):
    from tuplespace.sources.binary import read_image_vectors, write_image_vectors

    schema = "asin string, iev array<double>"
    for k, row in enumerate([("longer than ten", [1.0]), (None, [1.0]), ("a", None), ("a", [1.0, 2.0])]):
        path = tmp_path / f"r{k}"
        with pytest.raises(Exception):  # noqa: B017
            write_image_vectors(spark.createDataFrame([row], schema), str(path), 1)
        assert not list(path.glob("*.bin"))
    (tmp_path / "odd.bin").write_bytes(b"0123456789abc")
    with pytest.raises(Exception):  # noqa: B017
        read_image_vectors(spark, str(tmp_path / "odd.bin"), 1).collect()


def test_load_or_build(spark, tmp_path):
    from tuplespace.sources.materialize import load_or_build

    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    p = str(tmp_path / "m")
    assert load_or_build(spark, p, build).count() == 5
    assert load_or_build(spark, p, build).count() == 5
    assert len(calls) == 1


def test_meta_titles(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1\x01c\x01T1\x01u\n2\x01c\x01\x01u\n")
    got = src.read_meta_titles(spark, str(tmp_path / "m.txt")).collect()
    assert [(r["item_id"], r["title"]) for r in got] == [("1", "T1")]
    assert F is not None


def test_quotes_survive_the_text_round_trip(spark, tmp_path):
    rows = [("1", "c", '"x', "u"), ("2", "c", 'a "b" c', "v"), ("3", "c", "plain", 'w"')]
    write_text(spark.createDataFrame(rows, "item_id string, cat string, title string, url string"), str(tmp_path / "m"))
    back = src.read_meta_titles(spark, str(tmp_path / "m")).collect()
    assert {(r["item_id"], r["title"]) for r in back} == {(r[0], r[2]) for r in rows}


def test_first_file_is_listed_not_scanned(spark, tmp_path):
    (tmp_path / "part-1").write_text("late\n")
    (tmp_path / "part-0").write_text("early\n")
    (tmp_path / "_SUCCESS").write_text("")
    assert [r["value"] for r in src.read_dir(spark, str(tmp_path), "first").collect()] == ["early"]


def test_counts_of_a_hot_anchor_pass_bigint(spark):
    from tuplespace.operators.tuples import tuple_counts

    per = spark.createDataFrame([(1, 3_000_000, 3_000_000, 3_000_000)] * 2, "i long, k_c long, k_s long, k_n long")
    wide = [F.col(f"k_{r}").cast("decimal(12,0)") for r in "csn"]
    product = (wide[0] * wide[1] * wide[2]).cast("decimal(38,0)")
    rows = per.withColumns({c: product for c in ("tuples_before_dedup", "tuples_train")}).withColumn("tuples_test", F.lit(1))
    assert int(tuple_counts(rows).first()["tuples_before_dedup"]) == 2 * 27 * 10**18
