"""Reports over the train split without forming it.

The train split is, per anchor i, the product of its distinct (i,c), (i,s) and (i,n)
pairs. Every term of the loss and every prediction reads one pair's distance (the
ranking reads two), so a sum over the product is a sum over pairs, each weighted by
the product of the other roles' counts: O(pairs) instead of O(tuples). The ranking
needs, per anchor, the number of (c, n) with d2c < d2n, which one distributed running
count over (anchor, distance) gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.operators.metrics import unpivot_margins
from tuplespace.operators.ranks import running_totals


def rank_hits(dC: DataFrame, dN: DataFrame) -> DataFrame:
    """(i, pairs): per anchor the number of (c, n) with d2c < d2n. Equal distances
    do not count: negatives sort before complementary items there."""
    rows = dC.select(F.struct("i", F.col("d2c").alias("d"), F.lit(1).alias("is_c")).alias("o")).unionByName(
        dN.select(F.struct("i", F.col("d2n").alias("d"), F.lit(0).alias("is_c")).alias("o")))
    rows = rows.withColumn("is_c", F.col("o.is_c").cast("long"))
    # Rows that are equal throughout (two items at one distance) may share a running total only
    # within their kind, where it is the same before and after.
    cum = running_totals(rows.groupBy("o").agg(F.sum("is_c").alias("is_c"), F.count(F.lit(1)).alias("rows")), "o", ["is_c"])
    cum = cum.select(F.col("o.i").alias("i"), F.col("o.is_c").alias("kind"), "is_c", "rows", "is_c_cum")
    per = cum.groupBy("i").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("is_c_cum") * F.col("rows"))).alias("below"),
        F.sum(F.when(F.col("kind") == 0, F.col("rows"))).alias("negatives"),
        F.min(F.col("is_c_cum") - F.col("is_c")).alias("before"),
    )
    return per.select("i", (F.coalesce("below", F.lit(0)) - F.col("before") * F.coalesce("negatives", F.lit(0))).alias("pairs"))


def role_counts(dC: DataFrame, dS: DataFrame, dN: DataFrame) -> DataFrame:
    """(i, k_c, k_s, k_n) of the anchors that have all three roles."""
    count = lambda df, role: df.groupBy("i").agg(F.count(F.lit(1)).alias(f"k_{role}"))
    return count(dC, "c").join(count(dS, "s"), "i").join(count(dN, "n"), "i")


def product_sweep(dC: DataFrame, dS: DataFrame, dN: DataFrame, margins) -> DataFrame:
    """``metrics.margin_sweep`` of the product, from its pairs (i,c,d2c), (i,s,d2s), (i,n,d2n)."""
    hit = lambda condition: F.sum(condition.cast("long"))
    c, s, n = F.col("d2c"), F.col("d2s"), F.col("d2n")
    of_c, of_s, of_n = [F.count(F.lit(1)).alias("k_c")], [F.count(F.lit(1)).alias("k_s"), F.sum(s).alias("l_s")], [
        F.count(F.lit(1)).alias("k_n")]
    for k, (ms, mc, mn) in enumerate(margins):
        over, under = F.greatest(c - mc, F.lit(0.0)), F.greatest(F.lit(ms) - c, F.lit(0.0))
        of_c += [F.sum(over + under).alias(f"l_c{k}"), hit((c < mc) & (c > ms)).alias(f"h_c{k}")]
        of_s += [hit(s < ms).alias(f"h_s{k}")]
        of_n += [F.sum(F.greatest(F.lit(mn) - n, F.lit(0.0))).alias(f"l_n{k}"), hit(n > mc).alias(f"h_n{k}")]
    per = dC.groupBy("i").agg(*of_c).join(dS.groupBy("i").agg(*of_s), "i").join(dN.groupBy("i").agg(*of_n), "i")
    per = per.join(rank_hits(dC, dN), "i")
    kc, ks, kn = (F.col(f"k_{r}").cast("double") for r in "csn")
    total = F.sum(kc * ks * kn)
    aggs = [total.cast("long").alias("n_tuples"), (F.sum(ks * F.col("pairs")) / total).alias("acc_rank")]
    for k in range(len(margins)):
        loss = kc * kn * F.col("l_s") + ks * kn * F.col(f"l_c{k}") + kc * ks * F.col(f"l_n{k}")
        aggs += [(F.sum(loss) / total).alias(f"loss_{k}"), (F.sum(ks * kn * F.col(f"h_c{k}")) / total).alias(f"comp_{k}"),
                 (F.sum(kc * kn * F.col(f"h_s{k}")) / total).alias(f"sim_{k}"),
                 (F.sum(kc * ks * F.col(f"h_n{k}")) / total).alias(f"neg_{k}")]
    return unpivot_margins(per.agg(*aggs), margins)


def weighted_samples(dC: DataFrame, dS: DataFrame, dN: DataFrame) -> DataFrame:
    """(kind, i, item, d, w): each pair's distance and how many tuples of the product hold it."""
    counts = role_counts(dC, dS, dN)

    def of(df, kind, role, weight):
        return df.join(counts, "i").select(
            F.lit(kind).alias("kind"), "i", F.col(role).alias("item"), F.sqrt(f"d2{role}").alias("d"), weight.alias("w"))

    k = F.col
    return (of(dC, "comp", "c", k("k_s") * k("k_n")).unionByName(of(dS, "sim", "s", k("k_c") * k("k_n")))
            .unionByName(of(dN, "neg", "n", k("k_c") * k("k_s"))))
