"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to
``MAX_GRAM`` characters are hashed to ``FEATURES`` columns. Document frequencies cover
every training document. The weights are fitted on a bounded sample (the ``SAMPLE``
ids of each language with the lowest hashes) by follow-the-regularised-leader with an
elastic-net penalty: in each epoch the shards of the sample continue from the common
state, and Spark averages the states. A temperature fitted on further ``CALIBRATION``
ids of each language turns logits into probabilities, each language with the same prior
weight up to its bound, so that a rare one isn't lost. Every text is then predicted whole.

The fold rule is that of the contract: rows with crc32(doc_id as text) mod 3 = 1 are
held out. A null id isn't held out, and isn't trained on either. lang is read for fitting alone.

Cases: a text that is null or has no letter is ``und`` with score 0. Without any
training row every prediction is ``und``. Equal scores go to the language that comes
first. Repeated rows are predicted alike. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.llm.common import mix64, small_batches, text_blocks
from tuplespace.session import cut_lineage

MAX_GRAM = 3
FEATURES = 1 << 15
SAMPLE, CALIBRATION = 1_000, 375  # ids a language
SHARDS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: is it a letter?"""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(texts: list[str | None]):
    """For each text its (columns, counts) of hashed n-grams, or None without a letter."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    codes = np.where(is_letter, points, 32).astype(np.uint64)
    columns = []
    value = np.zeros(len(codes), np.uint64)
    powers = np.cumprod(np.full(MAX_GRAM, 0x9E3779B97F4A7C15, np.uint64))
    for n in range(1, MAX_GRAM + 1):  # columns[n - 1][k] is the n-gram that ends at k
        value[n - 1 :] += codes[: len(codes) - n + 1] * powers[n - 1]
        columns.append((mix64(value + np.uint64(n)) & np.uint64(FEATURES - 1)).astype(np.int32))
    begin = 0
    for end in ends.tolist():
        if not is_letter[begin:end].any():
            yield None
        else:
            counts = np.bincount(columns[0][begin:end], minlength=FEATURES)
            for n in range(2, MAX_GRAM + 1):
                counts += np.bincount(columns[n - 1][begin + n - 1 : end], minlength=FEATURES)
            found = np.flatnonzero(counts)
            yield found, counts[found]
        begin = end


def weighted(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values, term frequency on a log scale."""
    values = (1.0 + np.log(counts)) * idf[columns]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def fold(doc_id: Column) -> Column:
    """True where the contract holds a row out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many training texts hold each column, over all of them, and their number."""
    def run(batches):
        seen, total = np.zeros(FEATURES, np.int64), 0
        for block in text_blocks(batches):
            for found in gram_counts(block.column("text").to_pylist()):
                if found is not None:
                    seen[found[0]] += 1
                    total += 1
        columns = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, columns]), pa.array(np.r_[total, seen[columns]])], names=["column", "n"])

    rows = train.select("text").mapInArrow(run, "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    out, total = np.zeros(FEATURES, np.int64), 0
    for column, n in rows.collect():  # at most FEATURES + 1 rows
        if column < 0:
            total = n
        else:
            out[column] = n
    return out, total


def _sample(train: DataFrame, size: int) -> DataFrame:
    """For each language the ``size`` training ids with the lowest hashes (all with less), one row each, with its least text."""
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # Spark cuts to ``size`` before the shuffle
    ids = train.select("lang", "doc_id").distinct().withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= size)
    ids = cut_lineage(ids.select("lang", "doc_id"), "langid-ids")  # size rows a language
    return train.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def ftrl_pass(rows, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> None:
    """One pass of follow-the-regularised-leader over (columns, values, class) rows, in place."""
    for columns, values, label in rows:
        zi, ni = z[columns], n[columns]
        root = np.sqrt(ni)
        w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + root) / alpha + l2)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        grown = ni + g * g
        z[columns] = zi + g - (np.sqrt(grown) - root) / alpha * w
        n[columns] = grown


def _shard_pass(z: np.ndarray, n: np.ndarray, epoch: int):
    """The function that continues a shard's rows from the common state, in a seeded order."""
    def one_pass(table: pa.Table) -> pa.Table:
        own_z, own_n = z.copy(), n.copy()
        ids = np.asarray(table.column("doc_id").combine_chunks()).astype(np.int64).view(np.uint64)
        order = np.argsort(mix64(ids + np.uint64(epoch)), kind="stable")
        columns, values = (table.column(c).combine_chunks() for c in ("columns", "values"))
        labels = np.asarray(table.column("label").combine_chunks())
        rows = ((np.asarray(columns[k].values), np.asarray(values[k].values), labels[k]) for k in order.tolist())
        ftrl_pass(rows, own_z, own_n, ALPHA, BETA, L1, L2)
        return pa.table({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

    one_pass.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return one_pass


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def leader_weights(z, n, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> np.ndarray:
    """Sparse weights of the state: zero wherever |z| does not exceed the L1 penalty."""
    return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least mean negative log-likelihood, to about one percent.

    A share 1 / (rows + 2) of each target is spread evenly, so that separable rows
    do not ask for boundless confidence."""
    if not len(labels):
        return 1.0
    spread = 1.0 / (len(labels) + 2)

    def loss(t):
        logs = np.log(np.maximum(softmax(logits / t), 1e-300))
        return -np.mean((1 - spread) * logs[np.arange(len(labels)), labels] + spread * logs.mean(axis=1))

    grid = np.geomspace(0.01, 10, 40)
    best = grid[int(np.argmin([loss(t) for t in grid]))]
    near = np.geomspace(best / 1.2, best * 1.2, 41)
    return float(near[int(np.argmin([loss(t) for t in near]))])


class LanguageModel:
    """Languages, IDF, weights (columns x languages) and temperature; predicts whole texts."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, found) -> np.ndarray:
        columns, counts = found
        return weighted(columns, counts, self.idf) @ self.weights[columns]

    def predict(self, docs: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """``docs`` with the language and its probability as ``names``, in place of columns of that name."""
        model = self
        rest = [c for c in docs.columns if c not in names]
        docs = docs.select(*rest)

        def run(batches):
            for block in text_blocks(batches):
                langs, scores = [], []
                for found in gram_counts(block.column("text").to_pylist()):
                    if found is None or not model.languages:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        p = softmax(model.logits(found) / model.temperature)
                        best = int(np.argmax(p))
                        langs.append(model.languages[best])
                        scores.append(float(p[best]))
                arrays = [block.column(c) for c in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *names])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def train_language_model(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> LanguageModel:
    """Fit on the training fold of ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = train.where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r[0] for r in train.select("lang").distinct().collect())  # the classes
    seen, total = document_frequencies(train)
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    if not total:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), 1.0)
    index = {name: k for k, name in enumerate(languages)}

    def features(batches):
        for block in text_blocks(batches):
            keep, columns, values = [], [], []
            for k, found in enumerate(gram_counts(block.column("text").to_pylist())):
                if found is not None:
                    keep.append(k)
                    columns.append(found[0].astype(np.int32))
                    values.append(weighted(*found, idf))
            labels = [index[block.column("lang")[k].as_py()] for k in keep]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(labels, pa.int32()),
                 pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                names=["doc_id", "label", "columns", "values"])

    # By hash, so that about ``sample`` of a language's ids train.
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(sample + calibration))
    shard = F.when(part >= sample, F.lit(-1)).otherwise(F.pmod(part, F.lit(SHARDS))).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (_sample(train, sample + calibration)
            .mapInArrow(features, f"doc_id {kind}, label int, columns array<int>, values array<double>")
            .withColumn("shard", shard))
    rows = cut_lineage(rows, "langid-sample")

    shape = (FEATURES, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    for epoch in range(EPOCHS):
        one_pass = _shard_pass(z, n, epoch)
        states = rows.where("shard >= 0").groupBy("shard").applyInArrow(one_pass, "z binary, n binary").collect()
        if not states:
            break
        z = np.mean([np.frombuffer(s.z).reshape(shape) for s in states], axis=0)  # SHARDS states
        n = np.mean([np.frombuffer(s.n).reshape(shape) for s in states], axis=0)
    model = LanguageModel(languages, idf, leader_weights(z, n), 1.0)
    weights = model.weights

    def logits(batches):
        for batch in batches:
            out = [(np.asarray(v.values) @ weights[np.asarray(c.values)]).tolist()
                   for c, v in zip(batch.column("columns"), batch.column("values"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.float64()))],
                                             names=["label", "logits"])

    held = rows.where("shard < 0").select("label", "columns", "values").mapInArrow(
        logits, "label int, logits array<double>").collect()  # about CALIBRATION rows
    model.temperature = fit_temperature(np.array([r.logits for r in held]).reshape(len(held), -1),
                                        np.array([r.label for r in held], np.int64))
    return model


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train_language_model(docs)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return model.predict(texts).select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
