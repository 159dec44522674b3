"""Registered distribution reports (A8-A10) over the distance samples of both splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuplespace.operators.density import BW_FACTOR, FINE_BINS, GRID_PAD, GRID_POINTS, HIST_BINS, IQR_SCALE
from tuplespace.plans.oracle import with_ctes
from tuplespace.plans.registry import _L0, _P0, job, register, rounded

_SAMPLES = "SELECT split, kind, sqrt(d2) AS d FROM (" + " UNION ALL ".join(
    f"SELECT '{split}' AS split, '{kind}' AS kind, {d2} AS d2 FROM {split}_dist"
    for split in ("test", "train") for kind, d2 in (("comp", "d2c"), ("sim", "d2s"), ("neg", "d2n"))) + ")"
_PARAMS = (
    f"SELECT split, kind, n, sd, vmin, vmax, h, vmin - {GRID_PAD} * h AS glo, vmax + {GRID_PAD} * h AS ghi FROM ("
    f"SELECT split, kind, count(d) AS n, stddev_samp(d) AS sd, min(d) AS vmin, max(d) AS vmax, "
    f"{BW_FACTOR} * least(stddev_samp(d), (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) / {IQR_SCALE}) "
    f"* pow(count(d), -0.2) AS h FROM ({_SAMPLES}) GROUP BY split, kind)"
)


def _samples(spark, sf_dir):
    """(series, d, w) of both splits; the train split's pairs with their weights, not its tuples."""
    from tuplespace.operators.product_reports import weighted_samples

    j = job(spark, sf_dir)
    test = j.distances("test").selectExpr("stack(3, 'comp', d2c, 'sim', d2s, 'neg', d2n) AS (kind, d2)").select(
        F.concat(F.lit("test/"), "kind").alias("series"), F.sqrt("d2").alias("d"), F.lit(1).cast("long").alias("w"))
    train = weighted_samples(*j.part_distances()).select(F.concat(F.lit("train/"), "kind").alias("series"), "d", "w")
    return test.unionByName(train)


def _by_split(df):
    part = F.split("series", "/")
    return rounded(df.select(part[0].alias("split"), part[1].alias("kind"), *[c for c in df.columns if c != "series"]))


@register(
    "distance_density",
    with_ctes(
        "SELECT p.split, p.kind, CAST(k.k AS INTEGER) AS k, round(p.glo + k.k * (p.ghi - p.glo) / "
        f"{GRID_POINTS - 1}, 6) AS g, round(avg(exp(-0.5 * pow((s.d - (p.glo + k.k * (p.ghi - p.glo) / "
        f"{GRID_POINTS - 1})) / p.h, 2))) / (p.h * sqrt(2 * pi())), 6) AS density "
        f"FROM ({_PARAMS}) p JOIN ({_SAMPLES}) s ON s.split = p.split AND s.kind = p.kind CROSS JOIN range({GRID_POINTS}) k(k) "
        "GROUP BY p.split, p.kind, k.k, p.glo, p.ghi, p.h",
        "test_dist", "train_dist",
    ),
)
def q_distance_density(spark, sf_dir):
    """Gaussian KDE of both splits' distances per kind on a 100-point grid."""
    from tuplespace.operators.density import density_grid

    return _by_split(density_grid(_samples(spark, sf_dir), by="series", weight="w"))


_DELTA = f"((p.ghi - p.glo) / {(GRID_POINTS - 1) * FINE_BINS})"
_NODES = (
    "SELECT split, kind, bin, sum(m) AS m FROM ("
    "SELECT split, kind, unnest([{'bin': low, 'm': low + 1 - place}, {'bin': low + 1, 'm': place - low}], recursive := true) "
    f"FROM (SELECT s.split, s.kind, (s.d - p.glo) / {_DELTA} AS place, floor((s.d - p.glo) / {_DELTA}) AS low "
    f"FROM ({_SAMPLES}) s JOIN ({_PARAMS}) p ON s.split = p.split AND s.kind = p.kind)) GROUP BY split, kind, bin"
)


@register(
    "density_binned",
    with_ctes(
        f"SELECT p.split, p.kind, CAST(k.k AS INTEGER) AS k, round(p.glo + k.k * {FINE_BINS} * {_DELTA}, 6) AS g, "
        f"round(sum(b.m * exp(-0.5 * pow((k.k * {FINE_BINS} - b.bin) * {_DELTA} / p.h, 2))) / (p.n * p.h * sqrt(2 * pi())), 6) AS density, "
        f"round({_DELTA} * {_DELTA} / (8 * pow(p.h, 3) * sqrt(2 * pi())), 6) AS bound "
        f"FROM ({_PARAMS}) p JOIN ({_NODES}) b ON b.split = p.split AND b.kind = p.kind CROSS JOIN range({GRID_POINTS}) k(k) "
        "GROUP BY p.split, p.kind, k.k, p.glo, p.ghi, p.h, p.n",
        "test_dist", "train_dist",
    ),
)
def q_density_binned(spark, sf_dir):
    """A10: the density of A9 from pre-binned samples, with its error bound."""
    from tuplespace.operators.density import density_binned

    return _by_split(density_binned(_samples(spark, sf_dir), by="series", weight="w"))


@register(
    "distance_histogram",
    with_ctes(
        "SELECT split, kind, bucket, count(*) AS n, round(vmin + bucket * (vmax - vmin) / "
        f"{HIST_BINS}, 6) AS lo, round(vmin + (bucket + 1) * (vmax - vmin) / {HIST_BINS}, 6) AS hi FROM ("
        "SELECT s.split, s.kind, r.vmin, r.vmax, CAST(CASE WHEN r.vmax > r.vmin THEN least(floor((s.d - r.vmin) / "
        f"(r.vmax - r.vmin) * {HIST_BINS}), {HIST_BINS - 1}) ELSE 0 END AS INTEGER) AS bucket "
        f"FROM ({_SAMPLES}) s JOIN (SELECT split, kind, min(d) AS vmin, max(d) AS vmax FROM ({_SAMPLES}) GROUP BY split, kind) r "
        "ON r.split = s.split AND r.kind = s.kind) GROUP BY split, kind, bucket, vmin, vmax",
        "test_dist", "train_dist",
    ),
)
def q_distance_histogram(spark, sf_dir):
    """A10: 50 equal-width bins per kind (the scalable pre-binned companion of A9)."""
    from tuplespace.operators.density import histogram

    return _by_split(histogram(_samples(spark, sf_dir), by="series", weight="w"))


@register(
    "distance_samples_train",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, i, {r} AS item, round(sqrt(any_value(d2{r})), 6) AS d, count(*) AS w "
            f"FROM train_dist GROUP BY i, {r}" for kind, r in (("comp", "c"), ("sim", "s"), ("neg", "n"))),
        "train_dist",
    ),
)
def q_distance_samples_train(spark, sf_dir):
    """A8, train split: the distance of each pair and the number of tuples that hold it."""
    from tuplespace.operators.product_reports import weighted_samples

    return rounded(weighted_samples(*job(spark, sf_dir).part_distances()))


@register(
    "stream_accuracy",
    with_ctes(
        "SELECT count(*) AS n, round(avg(" + _L0["loss"] + "), 6) AS mean_loss, "
        + ", ".join(
            f"round(avg(CAST({_P0['pred_' + k]} AS DOUBLE)), 6) AS acc_{k}" for k in ("comp", "sim", "neg", "rank")
        )
        + " FROM test_dist",
        "test_dist",
    ),
)
def q_stream_accuracy(spark, sf_dir):
    """Structured Streaming: the encoded test tuples written as several `\\x01`
    files, scored file by file with running totals; the totals after the last
    micro-batch equal the accuracy over the whole test split."""
    from tuplespace.operators.encode import dense_ids, encode_tuples
    from tuplespace.plans.registry import M0
    from tuplespace.session import cut_lineage, scratch_path
    from tuplespace.sinks.text import write_text
    from tuplespace.streaming.score_stream import latest_metrics, start_scoring

    j = job(spark, sf_dir)
    ids = cut_lineage(dense_ids(j.vectors), "stream-ids")
    enc = encode_tuples(j.tuples_test, ids)
    base = scratch_path(spark, "stream")
    write_text(enc.select(F.lit(0).alias("pos"), *[f"{r}_idx" for r in "icsn"]).repartition(4), f"{base}/in")
    q = start_scoring(f"{base}/in", _stream_outputs(j, ids), M0, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return rounded(latest_metrics(spark, f"{base}/out"))


def _stream_outputs(j, ids):
    """(idx, out, scale): the vectors as they are and their normalising factor, written once: not joined anew in every micro-batch."""
    from tuplespace.functions.vectors import l2_scale
    from tuplespace.session import cut_lineage

    rows = j.vectors.join(ids, "item_id").select("idx", F.col("ev").alias("out"), l2_scale(F.col("ev")).alias("scale"))
    return cut_lineage(rows, "stream-outputs")


_ROUNDS = 2
SLICE_TUPLES = 1 << 24  # train tuples that are written for the stream at once, about


def _phase_sql(phase: str) -> str:
    accs = ", ".join(f"round(avg(CAST({_P0['pred_' + k]} AS DOUBLE)), 6) AS acc_{k}" for k in ("comp", "sim", "neg", "rank"))
    return (f"SELECT '{phase}' AS phase, CAST(r.r AS INTEGER) AS round, t.* FROM range({_ROUNDS}) r(r) CROSS JOIN "
            f"(SELECT count(*) AS n, round(avg({_L0['loss']}), 6) AS mean_loss, {accs} FROM {phase}_dist) t WHERE n > 0")


@register("stream_phases", with_ctes(_phase_sql("train") + " UNION ALL " + _phase_sql("test"), "test_dist", "train_dist"))
def q_stream_phases(spark, sf_dir):
    """A4, A5 as a stream: two rounds of a train and a test phase, file by file; each phase's metrics start from
    zero in each round, so every round ends with the metrics of its own pass."""
    from tuplespace.operators.encode import dense_ids, encode_tuples
    from tuplespace.operators.tuples import assemble_train, train_slices
    from tuplespace.plans.registry import M0
    from tuplespace.session import cut_lineage, delete_path, dropped_shuffles, scratch_path
    from tuplespace.sinks.text import write_text
    from tuplespace.streaming.score_stream import phase_metrics, start_phases

    j = job(spark, sf_dir)
    ids = cut_lineage(dense_ids(j.vectors), "stream-ids")
    base = scratch_path(spark, "phases")
    test = cut_lineage(encode_tuples(j.tuples_test, ids).select(*[F.col(f"{r}_idx").alias(r) for r in "icsn"]), "stream-test")
    # positions stand for ids one to one: the product of the encoded pairs is the encoded product
    parts = [cut_lineage(encode_tuples(part, ids, ("i", r)).select(F.col("i_idx").alias("i"), F.col(f"{r}_idx").alias(r)), f"stream-{r}")
             for part, r in zip(j.parts, "csn")]
    slices = train_slices(*parts, SLICE_TUPLES)
    passes = {"train": lambda: (assemble_train(*s) for s in slices), "test": lambda: [test]}
    outputs = _stream_outputs(j, ids)
    for number in range(_ROUNDS):  # one slice of a pass is on disk at a time: its files go once they are scored
        for phase, rows in passes.items():
            folder = f"{base}/in/phase={phase}/round={number}"
            for some in rows():
                with dropped_shuffles(spark):
                    write_text(some.select(F.lit(0).alias("pos"), *"icsn"), folder)
                start_phases(f"{base}/in", outputs, M0, f"{base}/out", f"{base}/ckpt").awaitTermination()
                delete_path(spark, folder)
    return rounded(phase_metrics(spark, f"{base}/out"))
