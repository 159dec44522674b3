"""Expressions on hand-made rows (FIXTURES.md)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuplespace.functions.hashing import draw_hash, pick
from tuplespace.functions.text import clean_title, decode_item_id, parse_paths, parse_paths_compact
from tuplespace.functions.vectors import l2_normalize, parse_vector, sq_distance, sum_squares


def test_decode_item_id(spark):
    df = spark.createDataFrame([("b'B00X'",), ("B00X",), ("b'b1'",)], "id string")
    got = [r[0] for r in df.select(decode_item_id(F.col("id"))).collect()]
    assert got == ["B00X", "B00X", "1"]  # every b and quote goes, also inside the id
    wrap = [r[0] for r in df.select(decode_item_id(F.col("id"), wrapper_only=True)).collect()]
    assert wrap == ["B00X", "B00X", "b1"]


def test_clean_title(spark):
    df = spark.createDataFrame([("a\nb",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_title(F.col("t"))).collect()] == ["a b", None]


def test_parse_paths(spark):
    rows = [('[["A","B"],["C"]]',), ('[["C"]]',), ("[[]]",), ('[["x]y","a, b"],["C"]]',), ('[["C"],["C"]]',)]
    df = spark.createDataFrame(rows, "c string")
    got = [r[0] for r in df.select(parse_paths(F.col("c"))).collect()]
    assert got[0] == ['["A","B"]', '["C"]']
    assert got[1] == ['["C"]']
    assert got[2] == []  # the empty path is removed
    assert got[3] == ['["C"]', '["x]y","a, b"]']  # names with ] and comma survive
    assert got[4] == ['["C"]', '["C"]']  # duplicates kept (weigh in the draw)


def test_parse_paths_compact(spark):
    df = spark.createDataFrame([("[[A,B],[C]]",)], "c string")
    assert df.select(parse_paths_compact(F.col("c"))).first()[0] == ["A,B", "C"]


def test_parse_vector(spark):
    df = spark.createDataFrame([("[1.0, 2.0]",), ("[3e-05]",), ("[]",), ("[1.0, x]",)], "t string")
    got = [r[0] for r in df.select(parse_vector(F.col("t"))).collect()]
    assert got[0] == [1.0, 2.0] and got[1] == [3e-05] and got[2] == [] and got[3] is None


def test_vector_math(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [3.0, 1.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>"
    )
    rows = df.select(sq_distance("a", "b").alias("d"), l2_normalize(F.col("a")).alias("u")).collect()
    assert rows[0]["d"] == 5.0
    assert rows[1]["u"] == [0.0, 0.0]  # zero vector stays zero
    assert rows[2]["d"] is None  # unequal lengths
    assert math.isclose(sum(x * x for x in rows[0]["u"]), 1.0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=8))
def test_normalized_length_is_zero_or_one(spark, v):
    n = spark.createDataFrame([(v,)], "v array<double>").select(sum_squares(l2_normalize(F.col("v")))).first()[0]
    assert math.isclose(n, 1.0, rel_tol=1e-9) or (n == 0.0 and sum(x * x for x in v) <= 1e-12) or \
        (sum(x * x for x in v) <= 1e-12)


def test_draw_hash_matches_duckdb(spark):
    import duckdb

    from tuplespace.functions.hashing import duck_draw_hash

    df = spark.createDataFrame([(1, 2), (10, 99)], "a long, b long")
    got = [r[0] for r in df.select(draw_hash("0", F.col("a"), F.col("b"), "item")).collect()]
    exp = [duckdb.sql(f"SELECT {duck_draw_hash('0', str(a), str(b), chr(39) + "item" + chr(39))}").fetchall()[0][0]
           for a, b in [(1, 2), (10, 99)]]
    assert got == exp and all(0 <= h < 2 ** 32 for h in got)
    assert df.select(pick(F.lit(5), F.lit(0))).first()[0] is None


def test_density_constants_sane():
    from tuplespace.operators.density import GRID_POINTS, HIST_BINS

    assert GRID_POINTS == 100 and HIST_BINS == 50
    assert np.isfinite(GRID_POINTS)
