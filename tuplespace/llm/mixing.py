"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share
``TOTAL`` times all words; a target stops at ``LIMIT`` times its source's words and
the excess is shared anew by weight. Every source takes whole copies of all its
documents while the target allows, and the remaining budget is fitted from a count
of its documents by exact length: the same share of every length first (rounded
down), then the longest that still fit, then a bounded-knapsack dynamic programme
over what is left. So the words taken miss the target by less than a document, and
mostly by nothing. Of each length the documents with the lowest seeded hashes are
taken.

Documents are numbered within (source, length) by a distributed rank over range
partitions: a length that holds a third of all rows is spread over many tasks. The
dynamic programme sees counts by length, never documents.

Cases: null text has size 0 and takes nothing (0 words), as do documents of a source
with no words. A null source is a source. Repeated rows are rows of their own, ties
in their hash are cut in any order, which is the same for all of them. Further
columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespace.llm.common import WORD_PATTERN, free_prefix
from tuplespace.operators.ranks import distributed_rank
from tuplespace.session import cut_lineage

WEIGHTS = (5, 2, 1)
TOTAL, LIMIT = 1.5, 2
PROGRAMME_WORDS = 1 << 16
SEED = 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = distributed_rank(totals.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank").drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    rows = cut_lineage(ranked.withColumn("weight", weight).drop("_rank"), "targets")
    most = F.col("source_size") * float(LIMIT)
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * TOTAL
    level = 0.0
    while True:  # each round stops at least one more source at its limit
        free = most > F.col("weight") * level
        capped, weights = rows.agg(F.sum(F.when(~free, most)), F.sum(F.when(free, F.col("weight")))).first()
        if not weights:
            break
        raised = (budget - (capped or 0.0)) / weights
        if raised <= level:
            break
        level = raised
    return rows.select("source", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, programme_words: int = PROGRAMME_WORDS) -> np.ndarray:
    """How many documents of each length to take: at most ``counts``, total at most ``budget`` and near it.

    Proportional shares come first, then the longest first, until the dynamic
    programme over the rest (at most ``programme_words``) finds the best total. Before
    it, documents are put back while the rest is small, so it has room to choose."""
    taken = np.zeros(len(lengths), np.int64)
    words = int(lengths @ counts)
    if budget <= 0 or not words:
        return taken
    if budget >= words:
        return counts.copy()
    taken = counts * budget // words if words * int(counts.max()) < 1 << 62 else np.array(
        [int(c) * budget // words for c in counts.tolist()], np.int64)
    rest = budget - int(lengths @ taken)
    order = np.argsort(-lengths, kind="stable")
    for k in order.tolist():
        if lengths[k] <= 0 or rest <= programme_words // 2:
            continue
        more = min(int(counts[k] - taken[k]), (rest - programme_words // 2) // int(lengths[k]))
        taken[k] += more
        rest -= more * int(lengths[k])
    for k in order[::-1].tolist():  # the shortest go back first, up to half the programme
        if lengths[k] <= 0:
            continue
        back = min(int(taken[k]), max(0, programme_words // 2 - rest) // int(lengths[k]))
        taken[k] -= back
        rest += back * int(lengths[k])
    for k in order.tolist():  # only more than the programme's words if few documents are left
        if rest > programme_words and lengths[k] > 0:
            more = min(int(counts[k] - taken[k]), (rest - programme_words) // int(lengths[k]))
            taken[k] += more
            rest -= more * int(lengths[k])
    return taken + _knapsack(lengths, counts - taken, min(rest, programme_words))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by binary splitting: counts whose total is the largest that ``budget`` allows."""
    chosen = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []  # (which length, how many of it)
    via = np.full(budget + 1, -1, np.int64)  # the item that first reached this total
    for k in np.argsort(-lengths, kind="stable").tolist():
        length, left = int(lengths[k]), int(counts[k])
        if length <= 0 or length > budget:
            continue
        left, part = min(left, budget // length), 1
        while left and not reached[budget]:
            n = min(part, left)
            left -= n
            part *= 2
            step = n * length
            new = reached[: budget + 1 - step] & ~reached[step:]
            via[step:][new] = len(items)
            items.append((k, n))
            reached[step:] |= new
        if reached[budget]:
            break
    total = int(np.flatnonzero(reached)[-1])
    while total:
        k, n = items[via[total]]
        chosen[k] += n
        total -= n * int(lengths[k])
    return chosen


def _quotas(histogram: DataFrame) -> DataFrame:
    """(source, size, copies, extra): whole copies of all, and how many documents of a size go once more."""
    def fit(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table.column("size").combine_chunks(), np.int64)
        order = np.argsort(lengths)
        counts = np.asarray(table.column("n").combine_chunks(), np.int64)
        total, target = int(lengths @ counts), float(table.column("target")[0].as_py())
        copies = int(target // total) if total else 0
        extra = np.empty_like(counts)
        extra[order] = fit_lengths(lengths[order], counts[order], round(target) - copies * total)
        return pa.table({"source": table.column("source"), "size": table.column("size"),
                         "copies": pa.array(np.full(len(counts), copies)), "extra": pa.array(extra)})

    fit.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return histogram.groupBy("source").applyInArrow(fit, "source string, size long, copies long, extra long")


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def with_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``, without its text: doc_id, source, digest (of the text), size,
    source_size, target, copies (how often the mix takes the row)."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("digest"))
    # Written once: the range sample of the rank would read all texts a second time.
    slim = cut_lineage(rows.withColumn("draw", F.xxhash64("doc_id", "digest", F.lit(seed))), "mix-rows")
    rows = distributed_rank(slim, ["source", "size", "draw"], "rank").drop("draw")
    lengths = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("start")),
                          "lengths")
    targets = cut_lineage(source_targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size"))), "mix-targets")
    with_target = lengths.join(targets, _same(lengths, targets, "source")).select(lengths["source"], "size", "n", "target")
    quotas = _quotas(with_target)
    plan = lengths.join(quotas, _same(lengths, quotas, "source", "size")).select(
        lengths["source"], lengths["size"], "start", "copies", "extra")
    plan = cut_lineage(plan.join(targets, _same(plan, targets, "source")).select(
        plan["source"].alias("_source"), F.col("size").alias("_size"), "start", "copies", "extra", "source_size", "target"),
        "mix-plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    once_more = (F.col("rank") - F.col("start") < F.col("extra")).cast("long")
    return joined.select("doc_id", "source", "digest", "size", "source_size", "target",
                         (F.col("copies") + once_more).alias("copies"))


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return with_copies(docs, seed).select("doc_id", "size", "source_size", "target",
                                          (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as the mix takes it.

    The decisions are joined to the texts by id, source and digest. Rows equal in all
    three share their copies: each gets the whole part, one of them the remainder."""
    own = free_prefix(docs.columns)
    names = [own + c for c in ("id", "source", "digest", "each", "rest", "copy")]
    id_, source, digest, each, rest, copy = names
    decided = with_copies(docs, seed).groupBy("doc_id", "source", "digest").agg(
        F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
    decided = cut_lineage(decided.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("digest").alias(digest),
                                         F.floor(F.col("all") / F.col("n")).alias(each), (F.col("all") % F.col("n")).alias(rest)),
                          "mix-decided")

    def joined(plan: DataFrame) -> DataFrame:
        match = (docs["doc_id"].eqNullSafe(F.col(id_)) & docs["source"].cast("string").eqNullSafe(F.col(source))
                 & (F.xxhash64(docs["text"].cast("string")) == F.col(digest)))
        return docs.join(plan, match)

    def repeated(rows: DataFrame, times: str) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(
            *[rows[c] for c in docs.columns])

    out = repeated(joined(decided.where(F.col(each) > 0)), each)
    uneven = decided.where(F.col(rest) > 0)
    if not uneven.isEmpty():
        out = out.unionByName(repeated(joined(uneven).dropDuplicates([id_, source, digest]), rest))
    return out
