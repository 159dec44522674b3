"""Tuple distances, loss terms and predictions (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.vectors import with_sq_distances

ROLES = ("i", "c", "s", "n")


def tuple_vectors(tuples: DataFrame, outputs: DataFrame, out_col: str = "out") -> DataFrame:
    """Attach the (tower) vector of each of the four roles: four equi-joins on the
    item id; the output table is per item, so AQE broadcasts it while it is small."""
    df = tuples
    for r in ROLES:
        df = df.join(outputs.select(F.col("item_id").alias(r), F.col(out_col).alias(f"v_{r}")), r)
    return df


def tuple_distances(tuples: DataFrame, outputs: DataFrame, out_col: str = "out") -> DataFrame:
    """Squared distances anchor-comp, anchor-sim, anchor-neg (d2c, d2s, d2n)."""
    tv = tuple_vectors(tuples, outputs, out_col)
    specs = [("v_i", "v_c", "d2c"), ("v_i", "v_s", "d2s"), ("v_i", "v_n", "d2n")]
    return with_sq_distances(tv, specs, list(tuples.columns))


def loss_terms(ms: float, mc: float, mn: float) -> dict[str, Column]:
    """sim = d2s (no hinge); c1 = relu(d2c - mc); c2 = relu(ms - d2c); neg = relu(mn - d2n)."""
    d2c, d2s, d2n = F.col("d2c"), F.col("d2s"), F.col("d2n")
    zero = F.lit(0.0)
    t = {
        "loss_sim": d2s,
        "loss_c1": F.greatest(d2c - F.lit(mc), zero),
        "loss_c2": F.greatest(F.lit(ms) - d2c, zero),
        "loss_neg": F.greatest(F.lit(mn) - d2n, zero),
    }
    t["loss"] = t["loss_sim"] + t["loss_c1"] + t["loss_c2"] + t["loss_neg"]
    return t


def predictions(ms: float, mc: float, mn: float) -> dict[str, Column]:
    """All strict; the negative prediction uses mc (not mn), as the reference does."""
    d2c, d2s, d2n = F.col("d2c"), F.col("d2s"), F.col("d2n")
    return {
        "pred_comp": (d2c < F.lit(mc)) & (d2c > F.lit(ms)),
        "pred_sim": d2s < F.lit(ms),
        "pred_neg": d2n > F.lit(mc),
        "pred_rank": d2c < d2n,
    }


def score(dist: DataFrame, margin: tuple[float, float, float]) -> DataFrame:
    ms, mc, mn = margin
    return dist.withColumns({**loss_terms(ms, mc, mn), **predictions(ms, mc, mn)})
