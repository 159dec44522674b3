"""Quality classifier: naive Bayes support vectors on byte n-gram indicators.

A text's features are the distinct n-grams of 1 to ``MAX_GRAM`` bytes it holds (case
and signs included), hashed to ``FEATURES`` columns. Each indicator is scaled by its
log-count ratio between the classes, r = log((p / |p|) / (q / |q|)), where p and q
count over every training row how many texts of the class hold the column, plus
``SMOOTH``; a row is scaled to length one. A linear hinge-loss model is then fitted by dual coordinate descent
with box constraints weighted so that both classes weigh the same. It is fitted on a
bounded sample: for each class the ``SAMPLE`` training ids with the lowest hashes, a
fifth of which fits the two numbers that turn margins into probabilities, at the
classes' true shares. Every text is then scored whole.

The fold rule is that of the contract: rows with crc32(doc_id as text) mod 4 = 2 are
held out. Labels are read for fitting alone.

Cases: a null or empty text has no feature and the score of margin 0 plus the bias.
Labels other than 0 and 1, and labels without a document, are not used. A document with
several labels, or several rows of one id, counts once for each pair of them in the
ratios; the sample holds an id once per class, with its least text. With one class or
none, every score is that class's smoothed share. Repeated rows score alike. A null id
is scored like others, held_out false. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespace.llm.common import mix64, small_batches, string_view, text_blocks
from tuplespace.session import cut_lineage

MAX_GRAM = 4
FEATURES = 1 << 17
SMOOTH = 1.0
SAMPLE = 3_000  # ids a class
COST, EPOCHS, TOLERANCE = 1.0, 30, 1e-2
THRESHOLD = 0.7


def gram_columns(array: pa.Array):
    """For each text the sorted distinct columns of its n-grams."""
    data, offsets = string_view(array)
    value = np.zeros(len(data), np.uint64)
    powers = np.cumprod(np.full(MAX_GRAM, 0x9E3779B97F4A7C15, np.uint64))
    codes, hashed = data.astype(np.uint64) + np.uint64(1), []
    for n in range(1, MAX_GRAM + 1):  # hashed[n - 1][k] is the n-gram that ends at k
        value[n - 1 :] += codes[: max(len(codes) - n + 1, 0)] * powers[n - 1]
        hashed.append((mix64(value + np.uint64(n)) & np.uint64(FEATURES - 1)).astype(np.int32))
    seen = np.zeros(FEATURES, bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for n in range(1, MAX_GRAM + 1):
            seen[hashed[n - 1][begin + n - 1 : max(end, begin + n - 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def fold(doc_id: Column) -> Column:
    """True where the contract holds a row out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Over all training rows: texts that hold each column by class (2 x FEATURES), and texts by class."""
    def run(batches):
        counts, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for block in text_blocks(batches):
            for label, found in zip(block.column("quality").to_pylist(), gram_columns(block.column("text")), strict=True):
                counts[label, found] += 1
                rows[label] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, some]), pa.array(np.r_[rows[0], counts[0, some]]), pa.array(np.r_[rows[1], counts[1, some]])],
            names=["column", "n0", "n1"])

    found = train.select("text", "quality").mapInArrow(run, "column long, n0 long, n1 long").groupBy("column").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for column, n0, n1 in found.collect():  # at most FEATURES + 1 rows
        if column < 0:
            rows[:] = n0, n1
        else:
            counts[:, column] = n0, n1
    return counts, rows


def count_ratios(counts: np.ndarray) -> np.ndarray:
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, bounds: np.ndarray, epochs: int = EPOCHS,
                 tolerance: float = TOLERANCE):
    """Hinge-loss weights by dual coordinate descent: (weights, bias, alphas); row i has ``0 <= alpha <= bounds[i]``.

    Each row is (columns, values) and has one further value 1 for the bias."""
    weights, bias, alphas = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            columns, values = rows[i]
            slope = signs[i] * (weights[columns] @ values + bias) - 1.0
            a = alphas[i]
            worst = max(worst, abs(min(slope, 0.0) if a <= 0 else max(slope, 0.0) if a >= bounds[i] else slope))
            alphas[i] = min(max(a - slope / squares[i], 0.0), bounds[i])
            if alphas[i] != a:
                change = (alphas[i] - a) * signs[i]
                weights[columns] += change * values
                bias += change
        if worst < tolerance:
            break
    return weights, bias, alphas


def scaled(found: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[found]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), each class weighing its share; targets are drawn in by one row a class."""
    sizes = np.array([(labels == c).sum() for c in (0, 1)])
    targets = np.where(labels == 1, (sizes[1] + 1) / (sizes[1] + 2), 1 / (sizes[0] + 2))
    weight = (shares / sizes)[labels]
    slope, offset = 1.0, float(np.log(shares[1] / shares[0]))
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(100):  # Newton with a small ridge: convex in two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        gradient = x @ (weight * (p - targets))
        if np.abs(gradient).max() < 1e-10:
            break
        curve = (x * (weight * p * (1 - p))) @ x.T + 1e-9 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        slope, offset = slope - move[0], offset - move[1]
    return max(float(slope), 0.0), float(offset)


class QualityModel:
    """Ratios, weights, bias and the sigmoid; scores whole texts."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratios, self.weights, self.bias, self.slope, self.offset = ratios, weights, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return float(scaled(found, self.ratios) @ self.weights[found]) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, score of every row of ``docs`` (doc_id, text)."""
        model = self

        def run(batches):
            for block in text_blocks(batches):
                scores = [model.score(found) for found in gram_columns(block.column("text"))]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        small_batches(docs.sparkSession)
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def _sample(texts: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """For each class the ``size`` ids with the lowest hashes among those with a text, one row each."""
    known = texts.select("doc_id").join(marks, "doc_id").distinct()
    lowest = [known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for label in (0, 1)]
    ids = cut_lineage(lowest[0].unionByName(lowest[1]), "quality-ids")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # 2 * size ids


def _fit(ratios: np.ndarray, shares: np.ndarray):
    """The function that fits weights and sigmoid on the whole (bounded) sample in one task."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
        labels = np.asarray(table.column("quality").combine_chunks()).astype(np.int64)
        held = np.asarray(table.column("calibrates").combine_chunks().cast(pa.int8())).astype(bool)
        found = [np.asarray(c.values) for c in table.column("columns").combine_chunks()]
        rest = ~held
        if min(len(np.unique(labels[held])), len(np.unique(labels[rest]))) < 2:  # too few rows to part
            held = rest = np.ones(len(labels), bool)
        rows = [(found[k], scaled(found[k], ratios)) for k in np.flatnonzero(rest).tolist()]
        own = labels[rest]
        bounds = COST * (len(own) / (2.0 * np.bincount(own, minlength=2)))[own]
        weights, bias, _ = dual_descent(rows, 2.0 * own - 1, bounds)
        model = QualityModel(ratios, weights, bias, 1.0, 0.0)
        margins = np.array([model.margin(found[k]) for k in np.flatnonzero(held).tolist()])
        slope, offset = fit_sigmoid(margins, labels[held], shares)
        return pa.table({"weights": [weights.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def train_quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on the training fold of ``labels`` (doc_id, quality) with the texts of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id")) & F.col("quality").isin(0, 1))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Always a merge join: labels grow with the documents, so no size of them may decide the plan.
    train = texts.join(marks.hint("merge"), "doc_id")
    counts, rows = class_counts(train)
    ratios, shares = count_ratios(counts), (rows + 1.0) / (rows.sum() + 2.0)
    if not rows.all():
        return QualityModel(ratios, np.zeros(FEATURES), 0.0, 0.0, float(np.log(shares[1] / shares[0])))

    def features(batches):
        for block in text_blocks(batches):
            found = [c.astype(np.int32) for c in gram_columns(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "quality", "columns"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = cut_lineage(_sample(texts, marks, sample).mapInArrow(features, f"doc_id {kind}, quality int, columns array<int>"), "quality-sample")
    chosen = chosen.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    fitted = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(
        _fit(ratios, shares), "weights binary, bias double, slope double, offset double").first()
    return QualityModel(ratios, np.frombuffer(fitted.weights), fitted.bias, fitted.slope, fitted.offset)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = train_quality_model(docs, labels).predict(docs)
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
