"""Metrics of a phase start from zero in each round, across micro-batches and restarts."""

import pathlib

import pandas as pd
import pytest

from tuplespace.streaming.score_stream import advance, phase_metrics, start_phases

MARGIN = (0.1, 0.5, 1.0)


class _State:
    def __init__(self):
        self.held = None

    @property
    def getOption(self):
        return self.held

    def update(self, value):
        self.held = value


def _rows(*rounds):
    return pd.DataFrame([(r, 2, 0.5, 1, 0, 2, 1) for r in rounds], columns=["round", "n", "sum_loss", "hit_comp", "hit_sim", "hit_neg", "hit_rank"])


def test_a_higher_round_resets_and_late_rows_stand_apart():
    state = _State()
    (first,) = advance(("train",), [_rows(0, 0), _rows(0)], state)
    assert first[["round", "late", "n"]].values.tolist() == [[0, False, 6]]
    (second,) = advance(("train",), [_rows(1, 0, 1)], state)  # round 0 ends inside a micro-batch
    assert second[["round", "late", "n"]].values.tolist() == [[0, False, 8], [1, False, 4]]
    (third,) = advance(("train",), [_rows(0, 1)], state)
    assert third[["round", "late", "n"]].values.tolist() == [[0, True, 2], [1, False, 6]]
    assert state.held == (1, 6, 1.5, 3, 0, 6, 3)


def _write(base, phase, number, name, quads):
    folder = base / f"phase={phase}" / f"round={number}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join("\x01".join(map(str, (0, *q))) + "\n" for q in quads))


def test_rounds_late_rows_and_a_restart(spark, tmp_path):
    outputs = spark.createDataFrame([(k, [k / 10.0, 1.0]) for k in range(8)], "idx int, out array<double>")
    src, run = tmp_path / "in", lambda: start_phases(
        str(src), outputs, MARGIN, str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files=1).awaitTermination()
    quads = [(0, k, 1, 7) for k in range(1, 8)]
    _write(src, "train", 0, "a.csv", quads)
    _write(src, "test", 0, "a.csv", quads[:2])
    run()
    _write(src, "train", 1, "b.csv", quads[:3])
    run()  # from the checkpoint: the state of the phases is still there
    _write(src, "train", 0, "late.csv", quads[:1] + [(0, 99, 1, 1)])  # a closed round; an unknown item
    _write(src, "train", 1, "c.csv", quads[3:4])
    run()
    got = {(r["phase"], r["round"]): r for r in phase_metrics(spark, str(tmp_path / "out")).collect()}
    assert {k: r["n"] for k, r in got.items()} == {("train", 0): 8, ("train", 1): 4, ("test", 0): 2}
    # by hand: d2c = (k/10)^2, d2s = 0.01, d2n = 0.49; comp hit for 0.1 < d2c < 0.5
    hits = [k for k in range(1, 8) if 0.1 < (k / 10) ** 2 < 0.5]
    assert abs(got["train", 0]["acc_comp"] - len(hits) / 8) < 1e-12
    assert got["train", 1]["acc_comp"] == 1 / 4 and got["test", 0]["acc_sim"] == 1.0


@pytest.mark.parametrize("blocks", [1, 3])
def test_scored_files_may_go_and_gathered_rows_go(spark, tmp_path, blocks, monkeypatch):
    """a pass's files are deleted before the next one; vectors beyond a block are gathered, not joined to the tuples."""
    import shutil

    from tuplespace.operators import lookup
    from tuplespace.session import checkpoint_base

    monkeypatch.setattr(lookup, "block_count", lambda *_: blocks)
    outputs = spark.createDataFrame([(k, [k / 10.0, 1.0], 1.0) for k in range(8)], "idx int, out array<double>, scale double")
    src, quads = tmp_path / "in", [(0, k, 1, 7) for k in range(1, 8)]
    scratch = lambda: set((pathlib.Path(checkpoint_base(spark)) / "tuplespace").glob("gather-rows-*"))
    before = scratch()
    for number, phase, rows in ((0, "train", quads), (0, "test", quads[:2]), (1, "train", quads[:3] + [(0, 99, 1, 1)])):
        _write(src, phase, number, "a.csv", rows)
        start_phases(str(src), outputs, MARGIN, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        shutil.rmtree(src / f"phase={phase}" / f"round={number}")
    got = {(r["phase"], r["round"]): r["n"] for r in phase_metrics(spark, str(tmp_path / "out")).collect()}
    assert got == {("train", 0): 7, ("test", 0): 2, ("train", 1): 3}
    assert scratch() == before


def test_sums_of_a_repeated_micro_batch_count_once(spark, tmp_path):
    from tuplespace.session import publish_file

    folder = str(tmp_path / "partials")
    (tmp_path / "partials").mkdir()
    for _ in range(2):
        publish_file(spark.range(1), folder, "batch-0")
    assert [f.name for f in (tmp_path / "partials").glob("*.parquet")] == ["batch-0.parquet"]
    assert spark.read.parquet(folder).count() == 1


def test_running_totals_of_a_scored_stream(spark, tmp_path):
    """the tuples' vectors are gathered; the totals after each micro-batch are those of all files so far."""
    from tuplespace.streaming.score_stream import latest_metrics, start_scoring

    outputs = spark.createDataFrame([(k, [k / 10.0, 1.0]) for k in range(8)], "idx int, out array<double>")
    (tmp_path / "in").mkdir()
    run = lambda: start_scoring(
        str(tmp_path / "in"), outputs, MARGIN, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    for name, ks in (("a", (1, 2)), ("b", (3, 4, 5))):
        (tmp_path / "in" / f"{name}.csv").write_text("".join(f"0\x010\x01{k}\x011\x017\n" for k in ks))
        run()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id").collect()] == [2, 5]
    assert latest_metrics(spark, str(tmp_path / "out")).first()["n"] == 5


def test_train_slices_are_even_and_hold_every_tuple_once(spark):
    from collections import Counter
    from itertools import product

    from tuplespace.operators.tuples import assemble_train, train_slices

    own = {i: (range(2), range(3), range(5)) for i in range(40)} | {99: (range(6), range(8), range(40))}  # a hot anchor
    parts = [spark.createDataFrame([(i, x) for i, p in own.items() for x in p[k]], f"i int, {r} int") for k, r in enumerate("csn")]
    want = Counter((i, *t) for i, p in own.items() for t in product(*p))
    for rows in (1 << 26, 800, 300):
        made = [[tuple(r) for r in assemble_train(*s).collect()] for s in train_slices(*parts, rows)]
        assert len(made) == -(-sum(want.values()) // rows) and Counter(t for m in made for t in m) == want
        assert max(map(len, made)) < 1.8 * rows
    assert [assemble_train(*s).count() for s in train_slices(*[p.limit(0) for p in parts], 10)] == [0]


def test_a_phase_is_streamed_slice_by_slice(spark, sf_small, monkeypatch):
    """neither the encoded train split nor its text lies on disk as a whole."""
    from tuplespace.plans import queries_report, registry
    from tuplespace.sinks import text

    want = sorted(map(tuple, registry.QUERIES["stream_phases"](spark, sf_small).collect()))
    n = {r[0]: r[2] for r in want}
    sizes, plain = [], text.write_text
    monkeypatch.setattr(queries_report, "SLICE_TUPLES", max(1, n["train"] // 3))
    monkeypatch.setattr(text, "write_text", lambda df, path: (plain(df, path), sizes.append(spark.read.text(path).count())))
    got = sorted(map(tuple, registry.QUERIES["stream_phases"](spark, sf_small).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(x - y) < 2e-6 for a, b in zip(got, want, strict=True) for x, y in zip(a[3:], b[3:], strict=True))
    assert sum(sizes) == 2 * (n["train"] + n["test"]) and len(sizes) >= 8 and max(sizes) < n["train"] / 2
