"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB twins.

Every query reads the supplied tables (or what Spark derives from them) in full.
Float outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespace.config import TupleConfig
from tuplespace.functions.hashing import draw_hash, duck_draw_hash as H
from tuplespace.functions.vectors import order_sum
from tuplespace.operators import paths, sampling, tuples
from tuplespace.plans.job import TupleJob
from tuplespace.plans.oracle import (
    linear_gradient_sql, loss_sql, margins_values, order_sum_sql, pred_sql, r6, with_ctes,
)
from tuplespace.plans.oracle_sgd import distances_sql, epoch_metrics_sql, fit_sql, one_step_sql, outputs_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def job(spark: SparkSession, sf_dir: str, **kw) -> TupleJob:
    return TupleJob(spark, sf_dir, TupleConfig(**kw) if kw else None)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column (both engines round to the same places)."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


M0 = TupleConfig().margin


# --- 1. cleaning, label split, path index, sampling ------------------------------------

@register("clean_catalog", with_ctes("SELECT asin, categories, title, imUrl FROM catalog", "catalog"))
def q_clean_catalog(spark, sf_dir):
    return job(spark, sf_dir).catalog


@register(
    "pairs_by_label",
    with_ctes(
        "SELECT 'comp' AS kind, item_id_1, item_id_2 FROM comp "
        "UNION ALL SELECT 'neg' AS kind, item_id_1, item_id_2 FROM neg",
        "comp", "neg",
    ),
)
def q_pairs_by_label(spark, sf_dir):
    j = job(spark, sf_dir)
    return j.comp.withColumn("kind", F.lit("comp")).unionByName(j.neg.withColumn("kind", F.lit("neg")))


@register("path_index", with_ctes("SELECT path, item_id FROM idx", "idx"))
def q_path_index(spark, sf_dir):
    return paths.path_index(job(spark, sf_dir).catalog)


@register("path_sizes", with_ctes("SELECT path, count(*) AS n_items FROM idx GROUP BY path", "idx"))
def q_path_sizes(spark, sf_dir):
    return paths.path_sizes(paths.path_index(job(spark, sf_dir).catalog))


@register(
    "anchor_catalog",
    with_ctes(
        "SELECT c.item_id_1, c.item_id_2, k.categories FROM comp c JOIN catalog k ON k.asin = c.item_id_1",
        "comp", "catalog",
    ),
)
def q_anchor_catalog(spark, sf_dir):
    j = job(spark, sf_dir)
    return sampling.anchor_catalog(j.comp, j.catalog)


@register(
    "sample_similar",
    with_ctes(
        "SELECT item_id_1, comp_id, path, item_id_2 FROM draws_item WHERE item_id_2 IS NOT NULL",
        "draws_item",
    ),
)
def q_sample_similar(spark, sf_dir):
    return job(spark, sf_dir).draws.filter(F.col("item_id_2").isNotNull())


@register(
    "sample_similar_no_self",
    with_ctes(
        "SELECT item_id_1, comp_id, path, item_id_2 FROM draws_noself WHERE item_id_2 IS NOT NULL",
        "draws_noself",
    ),
)
def q_sample_similar_no_self(spark, sf_dir):
    return job(spark, sf_dir, exclude_self=True).draws.filter(F.col("item_id_2").isNotNull())


@register(
    "unresolved_anchors",
    with_ctes(
        "SELECT 'keep_self' AS mode, count(*) FILTER (WHERE item_id_2 IS NULL) AS unresolved_rows, "
        "count(DISTINCT item_id_1) FILTER (WHERE item_id_2 IS NULL) AS unresolved_anchors, "
        "count(*) AS draw_rows FROM draws_item "
        "UNION ALL SELECT 'exclude_self' AS mode, count(*) FILTER (WHERE item_id_2 IS NULL), "
        "count(DISTINCT item_id_1) FILTER (WHERE item_id_2 IS NULL), count(*) FROM draws_noself",
        "draws_item", "draws_noself",
    ),
)
def q_unresolved_anchors(spark, sf_dir):
    def summary(mode, draws):
        miss = F.col("item_id_2").isNull()
        return draws.agg(
            F.count(F.when(miss, 1)).alias("unresolved_rows"),
            F.countDistinct(F.when(miss, F.col("item_id_1"))).alias("unresolved_anchors"),
            F.count(F.lit(1)).alias("draw_rows"),
        ).select(F.lit(mode).alias("mode"), "*")

    return summary("keep_self", job(spark, sf_dir).draws).unionByName(
        summary("exclude_self", job(spark, sf_dir, exclude_self=True).draws)
    )


# --- tuple assembly -------------------------------------------------------------------

@register("tuples_test", with_ctes("SELECT i, c, s, n FROM tuples_test", "tuples_test"))
def q_tuples_test(spark, sf_dir):
    return job(spark, sf_dir).tuples_test


@register(
    "tuples_train",
    with_ctes(
        "SELECT i, count(*) AS tuples, CAST(sum(" + H(TupleConfig().seed, "i", "c", "s", "n", "'sum'") + ") AS BIGINT) AS tuple_sum "
        "FROM (SELECT DISTINCT i, c, s, n FROM tuples_train) GROUP BY i",
        "tuples_train",
    ),
)
def q_tuples_train(spark, sf_dir):
    """The distinct train set, reported per anchor: its size and the sum of its tuples' hashes."""
    j = job(spark, sf_dir)
    each = draw_hash(j.cfg.seed, F.col("i"), F.col("c"), F.col("s"), F.col("n"), "sum")
    return j.tuples_train.groupBy("i").agg(F.count(F.lit(1)).alias("tuples"), F.sum(each).alias("tuple_sum"))


@register(
    "tuples_cs",
    with_ctes(
        "SELECT i, count(*) AS comp_sim_rows, CAST(sum(" + H(TupleConfig().seed, "i", "c", "s", "'sum'") + ") AS BIGINT) AS row_sum "
        "FROM (SELECT DISTINCT C.i, C.c, S.s FROM C JOIN S ON S.i = C.i) "
        "GROUP BY i",
        "C", "S",
    ),
)
def q_tuples_cs(spark, sf_dir):
    j = job(spark, sf_dir)
    C, S, _ = j.parts
    each = draw_hash(j.cfg.seed, F.col("i"), F.col("c"), F.col("s"), "sum")
    return tuples.comp_sim(C, S).groupBy("i").agg(F.count(F.lit(1)).alias("comp_sim_rows"), F.sum(each).alias("row_sum"))


@register(
    "tuples_all",
    with_ctes(
        "SELECT c.item_id_1 AS i, count(*) AS tuples_before_dedup, "
        "count(DISTINCT (c.item_id_2, s.item_id_2, n.item_id_2)) AS tuples_train "
        "FROM comp_v c JOIN sim_v s ON s.item_id_1 = c.item_id_1 JOIN neg_v n ON n.item_id_1 = c.item_id_1 "
        "GROUP BY c.item_id_1",
        "comp_v", "sim_v", "neg_v",
    ),
)
def q_tuples_all(spark, sf_dir):
    """Per-anchor size of the full join (bag) and of its distinct set, from grouped
    counts; the oracle forms the join by brute force."""
    return job(spark, sf_dir).fanout.select(
        "i", *[F.col(c).cast("long").alias(c) for c in ("tuples_before_dedup", "tuples_train")])


@register(
    "tuple_counts",
    with_ctes(
        "SELECT sum(kc * ks * kn) AS tuples_before_dedup, sum(dc * ds * dn) AS tuples_train, "
        "sum(dc) AS tuples_test, count(*) AS anchors FROM ("
        " SELECT a.i, a.k AS kc, a.d AS dc, b.k AS ks, b.d AS ds, c.k AS kn, c.d AS dn FROM"
        " (SELECT item_id_1 AS i, count(*) AS k, count(DISTINCT item_id_2) AS d FROM comp_v GROUP BY 1) a"
        " JOIN (SELECT item_id_1 AS i, count(*) AS k, count(DISTINCT item_id_2) AS d FROM sim_v GROUP BY 1) b ON b.i = a.i"
        " JOIN (SELECT item_id_1 AS i, count(*) AS k, count(DISTINCT item_id_2) AS d FROM neg_v GROUP BY 1) c ON c.i = a.i)",
        "comp_v", "sim_v", "neg_v",
    ),
)
def q_tuple_counts(spark, sf_dir):
    counts = tuples.tuple_counts(job(spark, sf_dir).fanout)
    return counts.select(*[F.col(c).cast("long").alias(c) for c in counts.columns])


# --- 2. pair distances and statistics ----------------------------------------------

@register(
    "pairs_with_vectors",
    with_ctes(
        "SELECT kind, item_id_1, item_id_2, len(ev1) AS dim1, len(ev2) AS dim2, "
        + r6(order_sum_sql("ev1"), "sum1") + ", " + r6(order_sum_sql("ev2"), "sum2")
        + " FROM pairs_v",
        "pairs_v",
    ),
)
def q_pairs_with_vectors(spark, sf_dir):
    return rounded(job(spark, sf_dir).pairs_v.select(
        "kind", "item_id_1", "item_id_2",
        F.size("ev1").alias("dim1"), F.size("ev2").alias("dim2"),
        order_sum(F.col("ev1")).alias("sum1"), order_sum(F.col("ev2")).alias("sum2"),
    ))


@register("pair_distance", with_ctes("SELECT kind, item_id_1, item_id_2, " + r6("eu", "eu") + " FROM pair_dist", "pair_dist"))
def q_pair_distance(spark, sf_dir):
    return rounded(job(spark, sf_dir).pair_dist)


@register("pair_distance_blocked", ORACLE["pair_distance"])
def q_pair_distance_blocked(spark, sf_dir):
    """The distances of ``pair_distance`` with items in four blocks, as beyond a broadcast."""
    return rounded(job(spark, sf_dir).pair_distances_in_passes(blocks=4))


@register(
    "distance_stats",
    with_ctes(
        "SELECT kind, count(eu) AS n, " + r6("avg(eu)", "mean") + ", " + r6("stddev_samp(eu)", "stddev")
        + ", " + r6("min(eu)", "min") + ", " + r6("max(eu)", "max") + " FROM pair_dist GROUP BY kind",
        "pair_dist",
    ),
)
def q_distance_stats(spark, sf_dir):
    from tuplespace.operators.metrics import distance_stats

    return rounded(distance_stats(job(spark, sf_dir).pair_dist))


# --- 3. scoring with vectors as they are ---------------------------------------------

@register(
    "l2_normalize",
    with_ctes(
        "SELECT item_id, " + r6("sqrt(list_sum(list_transform(ev, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))", "norm_in")
        + ", " + r6("sqrt(list_sum(list_transform(out, lambda x: x * x)))", "norm_out")
        + ", " + r6(order_sum_sql("out"), "out_sum") + " FROM (SELECT v.item_id, v.ev, o.out FROM vectors v "
        "JOIN outputs_id o ON o.item_id = v.item_id)",
        "vectors", "outputs_id",
    ),
)
def q_l2_normalize(spark, sf_dir):
    from tuplespace.functions.vectors import l2_normalize, sum_squares, as_double

    v = job(spark, sf_dir).vectors
    out = l2_normalize(F.col("ev"))
    return rounded(v.select(
        "item_id",
        F.sqrt(sum_squares(F.col("ev"))).alias("norm_in"),
        F.sqrt(sum_squares(out)).alias("norm_out"),
        order_sum(out).alias("out_sum"),
    ))


@register(
    "tuple_vectors",
    with_ctes(
        "SELECT t.i, t.c, t.s, t.n, "
        + ", ".join(r6(order_sum_sql(f"v{r}.ev"), f"sum_{r}") for r in "icsn")
        + " FROM tuples_test t "
        + " ".join(f"JOIN vectors v{r} ON v{r}.item_id = t.{r}" for r in "icsn"),
        "tuples_test", "vectors",
    ),
)
def q_tuple_vectors(spark, sf_dir):
    from tuplespace.operators.scoring import tuple_vectors

    j = job(spark, sf_dir)
    tv = tuple_vectors(j.tuples_test, j.vectors, out_col="ev")
    return rounded(tv.select("i", "c", "s", "n", *[order_sum(F.col(f"v_{r}")).alias(f"sum_{r}") for r in "icsn"]))


@register(
    "tuple_distance",
    with_ctes(
        "SELECT i, c, s, n, " + r6("d2c", "d2c") + ", " + r6("d2s", "d2s") + ", " + r6("d2n", "d2n")
        + ", " + r6("sqrt(d2c)", "dc") + ", " + r6("sqrt(d2s)", "ds") + ", " + r6("sqrt(d2n)", "dn")
        + " FROM test_dist",
        "test_dist",
    ),
)
def q_tuple_distance(spark, sf_dir):
    d = job(spark, sf_dir).distances("test")
    return rounded(d.withColumns({"dc": F.sqrt("d2c"), "ds": F.sqrt("d2s"), "dn": F.sqrt("d2n")}))


_L0 = loss_sql(*[str(x) for x in M0])
_P0 = pred_sql(*[str(x) for x in M0])


@register(
    "tuple_loss",
    with_ctes(
        "SELECT i, c, s, n, " + ", ".join(r6(v, k) for k, v in _L0.items()) + " FROM test_dist",
        "test_dist",
    ),
)
def q_tuple_loss(spark, sf_dir):
    from tuplespace.operators.scoring import loss_terms

    d = job(spark, sf_dir).distances("test")
    return rounded(d.select("i", "c", "s", "n", *[v.alias(k) for k, v in loss_terms(*M0).items()]))


@register(
    "tuple_predictions",
    with_ctes("SELECT i, c, s, n, " + ", ".join(f"{v} AS {k}" for k, v in _P0.items()) + " FROM test_dist", "test_dist"),
)
def q_tuple_predictions(spark, sf_dir):
    from tuplespace.operators.scoring import predictions

    d = job(spark, sf_dir).distances("test")
    return d.select("i", "c", "s", "n", *[v.alias(k) for k, v in predictions(*M0).items()])


def _acc_sql(src: str, split: str) -> str:
    return (
        f"SELECT '{split}' AS split, count(*) AS n_tuples, avg({_L0['loss']}) AS mean_loss, "
        + ", ".join(f"avg(CAST({_P0['pred_' + k]} AS DOUBLE)) AS acc_{k}" for k in ("comp", "sim", "neg", "rank"))
        + f" FROM {src}"
    )


_ROUND_ACC = (
    r6("mean_loss", "mean_loss") + ", " + ", ".join(r6(f"acc_{k}", f"acc_{k}") for k in ("comp", "sim", "neg", "rank"))
    + ", " + r6("acc_comp / (acc_comp + (1.0 - acc_comp))", "precision") + ", "
    + r6("acc_comp / (acc_comp + (1.0 - acc_neg))", "run_precision")
)


@register(
    "tuple_accuracy",
    with_ctes(
        "SELECT split, n_tuples, " + _ROUND_ACC
        + " FROM (" + _acc_sql("test_dist", "test") + " UNION ALL " + _acc_sql("train_dist", "train") + ")",
        "test_dist", "train_dist",
    ),
)
def q_tuple_accuracy(spark, sf_dir):
    return _sweep(job(spark, sf_dir), [M0]).drop("margin_id", "ms", "mc", "mn")


def _sweep(j: TupleJob, margins) -> DataFrame:
    """Loss and accuracies of both splits per margin: the test tuples are scored, the
    train product is summed from its pairs."""
    from tuplespace.operators.metrics import margin_sweep
    from tuplespace.operators.product_reports import product_sweep

    test = margin_sweep(j.distances("test"), margins)
    train = product_sweep(*j.part_distances(), margins)
    both = test.select(F.lit("test").alias("split"), "*").unionByName(train.select(F.lit("train").alias("split"), "*"))
    return rounded(both)


_SWEEP_SQL = " UNION ALL ".join(
    f"SELECT '{split}' AS split, m.margin_id, m.ms, m.mc, m.mn, count(*) AS n_tuples, "
    + f"avg({loss_sql()['loss']}) AS mean_loss, "
    + ", ".join(f"avg(CAST({pred_sql()['pred_' + k]} AS DOUBLE)) AS acc_{k}" for k in ("comp", "sim", "neg", "rank"))
    + f" FROM {split}_dist CROSS JOIN {margins_values()} GROUP BY m.margin_id, m.ms, m.mc, m.mn"
    for split in ("test", "train")
)


@register(
    "margin_sweep",
    with_ctes(
        "SELECT split, margin_id, CAST(ms AS DOUBLE) AS ms, CAST(mc AS DOUBLE) AS mc, CAST(mn AS DOUBLE) AS mn, n_tuples, "
        + _ROUND_ACC + " FROM (" + _SWEEP_SQL + ")",
        "test_dist", "train_dist",
    ),
)
def q_margin_sweep(spark, sf_dir):
    j = job(spark, sf_dir)
    return _sweep(j, j.cfg.margins)


@register(
    "best_margin",
    with_ctes(
        "SELECT split, margin_id, run_precision AS best_run_precision, CAST(ms AS DOUBLE) AS ms, "
        "CAST(mc AS DOUBLE) AS mc, CAST(mn AS DOUBLE) AS mn FROM ("
        "SELECT *, row_number() OVER (PARTITION BY split ORDER BY run_precision DESC, margin_id) AS place FROM ("
        "SELECT *, " + r6("acc_comp / (acc_comp + (1.0 - acc_neg))", "run_precision") + " FROM (" + _SWEEP_SQL + "))) "
        "WHERE place = 1",
        "test_dist", "train_dist",
    ),
)
def q_best_margin(spark, sf_dir):
    """The margin with the best precision of each split (the reference picks on the train split)."""
    from tuplespace.operators.metrics import best_margin

    sweep = q_margin_sweep(spark, sf_dir)
    of = lambda s: best_margin(sweep.where(F.col("split") == s), "run_precision").select(F.lit(s).alias("split"), "*")
    return of("test").unionByName(of("train"))


@register(
    "distance_samples",
    with_ctes(
        "SELECT split, kind, i, c, s, n, " + r6("sqrt(d2)", "d") + " FROM (" + " UNION ALL ".join(
            f"SELECT '{split}' AS split, i, c, s, n, '{kind}' AS kind, {d2} AS d2 FROM {split}_dist"
            for split in ("test", "train") for kind, d2 in (("comp", "d2c"), ("sim", "d2s"), ("neg", "d2n"))) + ")",
        "test_dist", "train_dist",
    ),
)
def q_distance_samples(spark, sf_dir):
    """The three distances of every tuple of both splits."""
    j = job(spark, sf_dir)
    tuples_of = lambda split: j.distances(split).select(F.lit(split).alias("split"), "*")
    long = tuples_of("test").unionByName(tuples_of("train")).selectExpr(
        "split", "i", "c", "s", "n", "stack(3, 'comp', d2c, 'sim', d2s, 'neg', d2n) AS (kind, d2)"
    )
    return rounded(long.select("split", "kind", "i", "c", "s", "n", F.sqrt("d2").alias("d")))


# --- 4. encoding and batching --------------------------------------------------------

BATCH = 256  # batch size of the registered batch reports


@register("dense_ids", with_ctes("SELECT item_id, idx FROM dense", "dense"))
def q_dense_ids(spark, sf_dir):
    from tuplespace.operators.encode import dense_ids

    return dense_ids(job(spark, sf_dir).vectors)


@register(
    "tuples_encoded",
    with_ctes(
        "SELECT t.i, t.c, t.s, t.n, "
        + ", ".join(f"CAST(d{r}.idx AS INTEGER) AS {r}_idx" for r in "icsn")
        + " FROM tuples_test t " + " ".join(f"JOIN dense d{r} ON d{r}.item_id = t.{r}" for r in "icsn"),
        "tuples_test", "dense",
    ),
)
def q_tuples_encoded(spark, sf_dir):
    from tuplespace.operators.encode import dense_ids, encode_tuples

    j = job(spark, sf_dir)
    return encode_tuples(j.tuples_test, dense_ids(j.vectors))


@register("tuples_shuffled", with_ctes("SELECT i, c, s, n, pos FROM test_pos", "test_pos"))
def q_tuples_shuffled(spark, sf_dir):
    from tuplespace.operators.tuples import shuffled_positions

    return shuffled_positions(job(spark, sf_dir).tuples_test, job(spark, sf_dir).cfg.seed)


_MB = f"SELECT i, c, s, n, pos, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch_id FROM test_pos"


@register(
    "minibatches",
    with_ctes(f"SELECT * FROM ({_MB}) WHERE batch_id < (SELECT count(*) // {BATCH} FROM test_pos)", "test_pos"),
)
def q_minibatches(spark, sf_dir):
    from tuplespace.operators.batches import minibatches

    return minibatches(job(spark, sf_dir).tuples_test, BATCH)


@register("minibatches_keep", with_ctes(_MB, "test_pos"))
def q_minibatches_keep(spark, sf_dir):
    from tuplespace.operators.batches import minibatches

    return minibatches(job(spark, sf_dir).tuples_test, BATCH, drop_remainder=False)


def _scored_batches(spark, sf_dir):
    from tuplespace.operators.batches import minibatches
    from tuplespace.operators.metrics import batch_metrics
    from tuplespace.operators.scoring import score

    j = job(spark, sf_dir)
    mb = minibatches(j.tuples_test, BATCH).select("i", "c", "s", "n", "batch_id")
    return batch_metrics(score(j.row_distances(mb), M0))  # batched first, scored after: no join back


_BATCH_SQL = (
    f"SELECT b.batch_id, count(*) AS n, sum({_L0['loss']}) AS sum_loss, "
    + ", ".join(f"sum(CAST({_P0['pred_' + k]} AS BIGINT)) AS hit_{k}" for k in ("comp", "sim", "neg", "rank"))
    + f" FROM test_dist d JOIN ({_MB}) b ON b.i = d.i AND b.c = d.c AND b.s = d.s AND b.n = d.n "
    f"WHERE b.batch_id < (SELECT count(*) // {BATCH} FROM test_pos) GROUP BY b.batch_id"
)


@register(
    "batch_loss",
    with_ctes(f"SELECT batch_id, n, {r6('sum_loss / n', 'mean_loss')} FROM ({_BATCH_SQL})", "test_dist", "test_pos"),
)
def q_batch_loss(spark, sf_dir):
    return rounded(_scored_batches(spark, sf_dir).select("batch_id", "n", "mean_loss"))


@register(
    "running_accuracy",
    with_ctes(
        "SELECT batch_id, "
        + ", ".join(
            r6(f"sum(hit_{k}) OVER (ORDER BY batch_id) / sum(n) OVER (ORDER BY batch_id)", f"acc_{k}")
            for k in ("comp", "sim", "neg", "rank")
        )
        + f", {r6('sum_loss / n', 'batch_loss')} FROM ({_BATCH_SQL})",
        "test_dist", "test_pos",
    ),
)
def q_running_accuracy(spark, sf_dir):
    from tuplespace.operators.metrics import running_accuracy

    return rounded(running_accuracy(_scored_batches(spark, sf_dir)))


# --- 6. tower forward and evaluation ---------------------------------------------------

DIMS = (64, 16, 12, 8)


def _rational_layers():
    from tuplespace.operators.tower import rational_weights

    return rational_weights(DIMS)


@register(
    "tower_forward",
    with_ctes(
        "SELECT item_id, " + ", ".join(r6(f"out[{k + 1}]", f"o{k}") for k in range(DIMS[-1])) + " FROM outputs_tower",
        "outputs_tower",
    ),
)
def q_tower_forward(spark, sf_dir):
    out = job(spark, sf_dir).outputs(_rational_layers())
    return rounded(out.select("item_id", *[F.col("out")[k].alias(f"o{k}") for k in range(DIMS[-1])]))


@register(
    "evaluate",
    with_ctes(
        "SELECT m.margin_id, count(*) AS n_tuples, " + r6(f"avg({loss_sql()['loss']})", "mean_loss") + ", "
        + ", ".join(r6(f"avg(CAST({pred_sql()['pred_' + k]} AS DOUBLE))", f"acc_{k}") for k in ("comp", "sim", "neg", "rank"))
        + f" FROM tower_dist CROSS JOIN {margins_values()} GROUP BY m.margin_id",
        "tower_dist",
    ),
)
def q_evaluate(spark, sf_dir):
    """Test split through the shared tower (fixed rational weights), every margin."""
    from tuplespace.operators.metrics import margin_sweep

    j = job(spark, sf_dir)
    sw = margin_sweep(j.distances("test", _rational_layers()), j.cfg.margins)
    return rounded(sw.select("margin_id", "n_tuples", "mean_loss", "acc_comp", "acc_sim", "acc_neg", "acc_rank"))


# --- 8. training ----------------------------------------------------------------------

FIT_BATCH = 131072  # large synchronous batches for the registered fits; the last, smaller batch counts too


def _mean_gradient(spark, tuples, vectors):
    from tuplespace.operators.scoring import tuple_vectors
    from tuplespace.operators.tower import rational_weights
    from tuplespace.operators.train import gradient_sums

    layers = rational_weights((DIMS[0], DIMS[-1]))
    rows = tuple_vectors(tuples, vectors, out_col="ev")
    g, stats = gradient_sums(rows, layers, M0)
    data = [(k, float(round(v / stats[0], 6))) for k, v in enumerate(g)]
    return spark.createDataFrame(data, "param long, g double")


@register("train_gradient", with_ctes(linear_gradient_sql(M0), "tuples_test", "vectors"))
def q_train_gradient(spark, sf_dir):
    """Mean loss gradient over the test tuples for a one-layer linear tower
    (64 -> 8, rational weights): numpy partials per task, summed by Spark."""
    j = job(spark, sf_dir)
    return _mean_gradient(spark, j.tuples_test, j.vectors)


@register("train_split_gradient", with_ctes(linear_gradient_sql(M0, source="tuples_train"), "tuples_train", "vectors"))
def q_train_split_gradient(spark, sf_dir):
    """The same gradient over all train tuples, from their pairs: the product isn't formed."""
    from tuplespace.operators.packed import product_gradient

    j, layers = job(spark, sf_dir), _linear_layers()
    g, n = product_gradient(j.part_distances(layers), j.outputs(layers), j.vectors, layers, M0)
    return spark.createDataFrame([(k, float(round(v / n, 6))) for k, v in enumerate(g)], "param long, g double")


LINEAR = (DIMS[0], DIMS[-1])  # the checked fits train one linear layer from the rational weights


def _linear_layers():
    from tuplespace.operators.tower import rational_weights

    return rational_weights(LINEAR)


def _fit_ctes(body: str, extra: list[str], *needs: str) -> str:
    """``body`` after the input's CTEs and ``extra``; the epochs' CTEs are recursive."""
    ctes = ["vec AS MATERIALIZED (SELECT item_id, CAST(ev AS DOUBLE[]) AS x FROM vectors)", *extra]
    head = with_ctes("", "tuples_train", "vectors", *needs).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return head + ",\n" + ",\n".join(ctes) + "\n" + body


def _fit_sql(body: str, margins, *needs: str) -> str:
    """``body`` after the CTEs of a whole epoch per margin, named m0, m1, ..."""
    cfg = TupleConfig()
    extra = [x for k, m in enumerate(margins) for x in fit_sql(m, cfg.lr, cfg.seed, FIT_BATCH, *LINEAR, name=f"m{k}")]
    return _fit_ctes(body, extra, *needs)


def _one_step_sql() -> str:
    after = distances_sql(f"(SELECT * FROM pos WHERE pos < {FIT_BATCH})", f"({outputs_sql('p1', *LINEAR)})", LINEAR[1])
    loss = "(" + " + ".join(f"({v})" for k, v in loss_sql(*[str(x) for x in M0]).items() if k != "loss") + ")"
    body = (
        "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM d0 UNION ALL "
        f"SELECT 'loss_before', round(avg({loss}), 6) FROM d0 UNION ALL "
        f"SELECT 'loss_after', round(avg({loss}), 6) FROM ({after}) UNION ALL "
        "SELECT 'grad_norm', round(sqrt(list_sum(list_transform(g, lambda v: v * v)) / len(g)), 6) FROM w0")
    cfg = TupleConfig()
    return _fit_ctes(body, one_step_sql(M0, cfg.lr, cfg.seed, FIT_BATCH, *LINEAR))


@register("train_one_step", _one_step_sql())
def q_train_one_step(spark, sf_dir):
    """One synchronous SGD step of a linear tower on the first train batch: loss before and after."""
    return _one_step(spark, sf_dir, _linear_layers())


def _one_step(spark, sf_dir, layers):
    from tuplespace.operators.packed import packed_sums
    from tuplespace.operators.train import grad_norm, sgd_step
    from tuplespace.plans.training import BatchSource

    j = job(spark, sf_dir)
    src = BatchSource(j.tuples_train, j.vectors, FIT_BATCH, j.cfg.seed, drop_remainder=False, batches_per_group=1, first=1)
    batch = src(0).packed(0)
    (g, s), = packed_sums(batch, [layers], [M0])
    new = sgd_step(layers, g, s[0], j.cfg.lr)
    (_, s2), = packed_sums(batch, [new], [M0])
    src.close()
    data = [("rows", float(s[0])), ("loss_before", float(s[1] / s[0])), ("loss_after", float(s2[1] / s2[0])),
            ("grad_norm", float(grad_norm(g / s[0])))]
    return rounded(spark.createDataFrame(data, "metric string, value double"))


@register("train_fit", _fit_sql(
    "SELECT step, metric, round(value, 6) AS value FROM (" + epoch_metrics_sql("m0") + ")", [M0]))
def q_train_fit(spark, sf_dir):
    """One epoch of synchronous SGD of a linear tower over the whole train split; its metric rows."""
    return _fit(spark, sf_dir, _linear_layers())


def _fit(spark, sf_dir, layers):
    from dataclasses import replace

    from tuplespace.plans.training import fit_margin, metrics_frame, new_run_id

    j = job(spark, sf_dir)
    cfg = replace(j.cfg, batch_size=FIT_BATCH, epochs=1, drop_remainder=False)
    _, rows = fit_margin(j.tuples_train, j.vectors, layers, M0, cfg)
    log = metrics_frame(spark, rows, new_run_id(), 0).where("metric <> 'seconds'")
    return rounded(log.select("step", "metric", "value"))


@register("fit_resumed", ORACLE["train_fit"])
def q_fit_resumed(spark, sf_dir):
    """The fit of ``train_fit``, stopped after its first step and resumed from its commit table by a new
    source, which reads the batches the first one left behind: its rows are those of the unbroken fit."""
    from dataclasses import replace

    from tuplespace.plans.training import BatchSource, Commits, Stopped, fit_margin, fit_margins, metrics_frame, new_run_id
    from tuplespace.session import delete_path, scratch_path

    j = job(spark, sf_dir)
    cfg = replace(j.cfg, batch_size=FIT_BATCH, epochs=1, drop_remainder=False)
    commits = Commits(spark, scratch_path(spark, "commits"), new_run_id(), cfg.seed, every=1)
    src = BatchSource(j.tuples_train, j.vectors, FIT_BATCH, cfg.seed, drop_remainder=False, home=commits.home)
    try:
        fit_margins(src, [_linear_layers()], [M0], cfg.lr, cfg.epochs, commits=commits, stop_after=1)
    except Stopped:
        src.leave()  # what a lost driver would leave behind
    _, rows = fit_margin(j.tuples_train, j.vectors, _linear_layers(), M0, cfg, commits=commits)
    delete_path(spark, commits.path)
    log = metrics_frame(spark, rows, commits.run_id, 0).where("metric <> 'seconds'")
    return rounded(log.select("step", "metric", "value"))


def _margin_fit_sql() -> str:
    margins = TupleConfig().margins
    rows = []
    for k, m in enumerate(margins):
        t = f"(SELECT sum(hit_comp) / sum(n) AS c, sum(hit_neg) / sum(n) AS a FROM m{k} WHERE step >= 0)"
        test = distances_sql("tuples_test", f"({outputs_sql(f'(SELECT max_by(p, step) AS p FROM m{k})', *LINEAR)})", LINEAR[1])
        rows.append(
            f"SELECT CAST({k} AS INTEGER) AS margin_id, CAST({m[0]} AS DOUBLE) AS ms, CAST({m[1]} AS DOUBLE) AS mc, CAST({m[2]} AS DOUBLE) AS mn, "
            f"round(c, 6) AS train_acc_comp, round(a, 6) AS train_acc_neg, round(c / (c + (1.0 - a)), 6) AS train_precision, "
            f"round((SELECT avg(CAST(d2c < d2n AS DOUBLE)) FROM ({test})), 6) AS test_acc_rank FROM {t}")
    return _fit_sql(" UNION ALL ".join(rows), margins, "tuples_test")


@register("margin_fit", _margin_fit_sql())
def q_margin_fit(spark, sf_dir):
    """One epoch of synchronous SGD per margin triple (the same fresh linear tower each), test
    evaluation after the epoch; one summary row per margin."""
    return _margin_fit(spark, sf_dir, _linear_layers())


def _margin_fit(spark, sf_dir, layers):
    from dataclasses import replace

    from tuplespace.plans.training import margin_fit

    j = job(spark, sf_dir)
    cfg = replace(j.cfg, batch_size=FIT_BATCH, epochs=1, drop_remainder=False)
    summary, _ = margin_fit(j, cfg, layers)
    return rounded(spark.createDataFrame(
        [tuple(float(r[k]) if k != "margin_id" else int(r[k]) for k in r) for r in summary],
        "margin_id int, ms double, mc double, mn double, train_acc_comp double, train_acc_neg double, "
        "train_precision double, test_acc_rank double",
    ))


# The same three fits of the full tower. SQL can't follow them, so they are kept apart from the queries with a twin.
TOWER_FITS: dict[str, Query] = {}


def _tower_fit(fn: Query) -> Query:
    TOWER_FITS[fn.__name__.removeprefix("q_")] = fn
    return fn


def _init_layers():
    """Training starts from Glorot-normal weights (seeded) like the reference; the outputs of the rational weights
    are so small that one step lets the bias dominate."""
    from tuplespace.operators.tower import glorot_weights

    return glorot_weights(DIMS, TupleConfig().init_seed)


@_tower_fit
def q_tower_one_step(spark, sf_dir):
    """One synchronous SGD step of the full tower on the first train batch: loss before and after."""
    return _one_step(spark, sf_dir, _init_layers())


@_tower_fit
def q_tower_fit(spark, sf_dir):
    """One epoch of synchronous SGD of the full tower over the whole train split; its metric rows."""
    return _fit(spark, sf_dir, _init_layers())


@_tower_fit
def q_tower_margin_fit(spark, sf_dir):
    """One epoch of the full tower per margin triple (the same fresh weights each), test evaluation after it."""
    return _margin_fit(spark, sf_dir, _init_layers())


_LOGGED = ("mean_loss", "acc_comp", "acc_sim", "acc_neg", "acc_rank")


@register(
    "metrics_log",
    "SELECT margin_id, CAST(0 AS INTEGER) AS epoch, CAST(0 AS BIGINT) AS step, 'test' AS split, metric, value FROM ("
    + " UNION ALL ".join(f"SELECT margin_id, '{m}' AS metric, {m} AS value FROM ({ORACLE['evaluate']})" for m in _LOGGED) + ")",
)
def q_metrics_log(spark, sf_dir):
    """The test split's metrics of every margin appended to a partitioned table and read back."""
    from tuplespace.plans.training import append_metrics, metrics_frame, new_run_id
    from tuplespace.session import scratch_path

    run, path = new_run_id(), scratch_path(spark, "metrics")
    for r in q_evaluate(spark, sf_dir).collect():  # one row per margin
        rows = [{"epoch": 0, "step": 0, "split": "test", "metric": m, "value": r[m]} for m in _LOGGED]
        append_metrics(metrics_frame(spark, rows, run, r["margin_id"]), path)
    log = spark.read.parquet(path).where(F.col("run_id") == run)
    return log.select("margin_id", "epoch", "step", "split", "metric", "value")


@register("weights_roundtrip", ORACLE["evaluate"])
def q_weights_roundtrip(spark, sf_dir):
    """Save the tower weights, load them back (warm start) and evaluate with them:
    must equal ``evaluate``."""
    from tuplespace.operators.metrics import margin_sweep
    from tuplespace.plans.training import load_weights, new_run_id, save_weights
    from tuplespace.session import scratch_path

    path, run = scratch_path(spark, "weights"), new_run_id()
    save_weights(spark, _rational_layers(), path, run, 0, 0)
    layers = load_weights(spark, path, run, 0)
    j = job(spark, sf_dir)
    sw = margin_sweep(j.distances("test", layers), j.cfg.margins)
    return rounded(sw.select("margin_id", "n_tuples", "mean_loss", "acc_comp", "acc_sim", "acc_neg", "acc_rank"))


# Further query groups register themselves on import.
from tuplespace.plans import queries_io  # noqa: E402,F401
from tuplespace.plans import queries_report  # noqa: E402,F401
