"""Distance distributions: exact quartiles, Gaussian KDE on a grid, histogram.

Everything is an aggregate over the samples joined to a per-kind parameter row
(one row per kind); the quartiles come from distributed running totals, so no group
is ever collected. The rows per kind are broadcast by hand: joined by kind, all samples would be dealt to as many
tasks as there are kinds. A sample may carry a weight: the train split's samples are its
distinct pairs, weighted by the tuples that hold them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.operators.ranks import running_totals
from tuplespace.session import cut_lineage

# Fixed values of our own density definition: Scott-style bandwidth
# 1.059 * min(sd, IQR / 1.349) * n^(-1/5), a 100-point grid reaching 3 bandwidths
# past the extremes, 50 histogram bins.
BW_FACTOR = 1.059
IQR_SCALE = 1.349
GRID_POINTS = 100
GRID_PAD = 3.0
HIST_BINS = 50
FINE_BINS = 16  # nodes of the binned density per step of the grid


def weighted(samples: DataFrame, by: str, value: str, weight: str | None) -> DataFrame:
    """(by, value, w): each sample with how often it counts (once without ``weight``)."""
    w = F.lit(1) if weight is None else F.col(weight)
    return samples.select(by, value, w.cast("long").alias("w"))


def quantiles(samples: DataFrame, by: str, value: str, qs=(0.25, 0.75), weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group (quantile_cont semantics):
    position q*(n-1) among the group's sorted values, a value counting ``weight`` times.
    Equal values are one row; distributed running totals of the weights place them."""
    rows = weighted(samples, by, value, weight).groupBy(by, value).agg(F.sum("w").alias("w"))
    rows = rows.withColumn("_o", F.struct(by, value))
    cum = running_totals(rows, "_o", ["w"])
    cum = cum.select(by, value, F.col("w_cum").alias("_to"), (F.col("w_cum") - F.col("w")).alias("_from"))
    spans = cum.groupBy(by).agg(F.min("_from").alias("_start"), F.max("_to").alias("_end"))
    out = spans.withColumn("_n", F.col("_end") - F.col("_start"))
    for k, q in enumerate(qs):
        pos = F.lit(q) * (F.col("_n") - 1)
        out = out.withColumns({f"_p{k}": pos, f"_lo{k}": F.col("_start") + F.floor(pos), f"_hi{k}": F.col("_start") + F.ceil(pos)})
    # One row per group meets the group's distinct values; each asks for the values at its places.
    def at(place):
        return F.max(F.when((F.col("_from") <= F.col(place)) & (F.col(place) < F.col("_to")), F.col(value)))

    keep = [f"_{x}{k}" for x in ("p", "lo") for k in range(len(qs))]
    found = cum.join(F.broadcast(out), by).groupBy(by, "_start", *keep).agg(
        *[at(f"_{x}{k}").alias(f"_v{x}{k}") for x in ("lo", "hi") for k in range(len(qs))])
    parts = [(F.col(f"_vlo{k}") + (F.col(f"_p{k}") - (F.col(f"_lo{k}") - F.col("_start"))) * (F.col(f"_vhi{k}") - F.col(f"_vlo{k}")))
             .alias(f"q{k}") for k in range(len(qs))]
    return found.select(by, *parts)


def kde_params(samples: DataFrame, by: str = "kind", value: str = "d", weight: str | None = None) -> DataFrame:
    """Per group: n, sd, min, max, quartiles, bandwidth h and the grid span."""
    rows = weighted(samples, by, value, weight)
    v, w = F.col(value), F.col("w")
    centre = rows.groupBy(by).agg((F.sum(v * w) / F.sum("w")).alias("_mean"))
    stats = rows.join(F.broadcast(centre), by).groupBy(by).agg(
        F.sum("w").alias("n"), F.sqrt(F.sum(w * F.pow(v - F.col("_mean"), 2)) / (F.sum("w") - 1)).alias("sd"),
        F.min(value).alias("vmin"), F.max(value).alias("vmax"),
    )
    q = quantiles(samples, by, value, weight=weight)
    spread = F.least(F.col("sd"), (F.col("q1") - F.col("q0")) / F.lit(IQR_SCALE))
    h = F.lit(BW_FACTOR) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return stats.join(F.broadcast(q), by).withColumn("h", h).withColumns({
        "glo": F.col("vmin") - F.lit(GRID_PAD) * F.col("h"),
        "ghi": F.col("vmax") + F.lit(GRID_PAD) * F.col("h"),
    })


def density_grid(samples: DataFrame, by: str = "kind", value: str = "d", weight: str | None = None) -> DataFrame:
    """(kind, k, g, density): one aggregate pass with one kernel average per grid
    point. The samples feed several passes (stats, quartiles, kernel sums), so they
    are written once first."""
    samples = cut_lineage(weighted(samples, by, value, weight), "samples")
    params = kde_params(samples, by, value, "w")
    step = (F.col("ghi") - F.col("glo")) / F.lit(GRID_POINTS - 1)
    joined = samples.join(F.broadcast(params.select(by, "h", "glo", "ghi")), by)
    aggs = []
    for k in range(GRID_POINTS):
        g = F.col("glo") + F.lit(k) * step
        bump = F.exp(F.lit(-0.5) * F.pow((F.col(value) - g) / F.col("h"), 2))
        aggs.append((F.sum(bump * F.col("w")) / F.sum("w")).alias(f"k{k}"))
    wide = joined.groupBy(by, "h", "glo", "ghi").agg(*aggs)
    rows = ", ".join(f"{k}, k{k}" for k in range(GRID_POINTS))
    long = wide.selectExpr(by, "h", "glo", "ghi", f"stack({GRID_POINTS}, {rows}) AS (k, m)")
    norm = F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return long.select(
        by, F.col("k").cast("int").alias("k"),
        (F.col("glo") + F.col("k") * (F.col("ghi") - F.col("glo")) / F.lit(GRID_POINTS - 1)).alias("g"),
        (F.col("m") / norm).alias("density"),
    )


def density_binned(samples: DataFrame, by: str = "kind", value: str = "d", weight: str | None = None,
                   fine: int = FINE_BINS) -> DataFrame:
    """(kind, k, g, density, bound): the density of ``density_grid`` from pre-binned samples.

    Each sample is shared between the two nodes beside it on a grid ``fine`` times finer
    (linear binning), in proportion to its nearness, and the node masses are convolved
    with the kernel. A sample's share of the result is then the kernel interpolated
    linearly between nodes ``delta`` apart, which differs from the kernel by at most
    delta^2 / 8 times its largest second derivative: |difference| <= ``bound`` =
    delta^2 / (8 h^3 sqrt(2 pi)). Work is one pass over the samples and bins x grid points after it."""
    samples = cut_lineage(weighted(samples, by, value, weight), "samples")
    params = kde_params(samples, by, value, "w").select(by, "n", "h", "glo", "ghi")
    params = cut_lineage(params.withColumn("delta", (F.col("ghi") - F.col("glo")) / F.lit((GRID_POINTS - 1) * fine)), "density-params")
    place = (F.col(value) - F.col("glo")) / F.col("delta")
    shares = samples.join(F.broadcast(params), by).withColumn("_at", place).withColumn("_low", F.floor("_at")).select(by, F.explode(F.array(
        F.struct(F.col("_low").alias("bin"), (F.col("w") * (F.col("_low") + 1 - F.col("_at"))).alias("m")),
        F.struct((F.col("_low") + 1).alias("bin"), (F.col("w") * (F.col("_at") - F.col("_low"))).alias("m")))).alias("_s"))
    bins = shares.groupBy(by, F.col("_s.bin").alias("bin")).agg(F.sum("_s.m").alias("m"))  # at most 99 * fine + 2 rows a kind
    apart = (F.col("k") * fine - F.col("bin")) * F.col("delta") / F.col("h")
    wide = bins.join(F.broadcast(params), by).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    summed = wide.groupBy(by, "k", "n", "h", "glo", "delta").agg(F.sum(F.col("m") * F.exp(F.lit(-0.5) * apart * apart)).alias("m"))
    root = F.lit(math.sqrt(2 * math.pi))
    return summed.select(by, "k", (F.col("glo") + F.col("k") * fine * F.col("delta")).alias("g"),
                         (F.col("m") / (F.col("n") * F.col("h") * root)).alias("density"),
                         (F.col("delta") * F.col("delta") / (8 * F.pow("h", F.lit(3)) * root)).alias("bound"))


def histogram(samples: DataFrame, by: str = "kind", value: str = "d", bins: int = HIST_BINS,
              weight: str | None = None) -> DataFrame:
    """(kind, bucket, n, lo, hi): equal-width bins over [min, max] per kind. The samples
    are written once, as they are read for the range and for the counts."""
    samples = cut_lineage(weighted(samples, by, value, weight), "samples")
    rng = samples.groupBy(by).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    width = (F.col("vmax") - F.col("vmin")) / F.lit(bins)
    b = F.when(F.col("vmax") > F.col("vmin"), F.least(
        F.floor((F.col(value) - F.col("vmin")) / (F.col("vmax") - F.col("vmin")) * F.lit(bins)), F.lit(bins - 1)
    )).otherwise(F.lit(0)).cast("int")
    counted = samples.join(F.broadcast(rng), by).groupBy(by, "vmin", "vmax", b.alias("bucket")).agg(F.sum("w").alias("n"))
    return counted.select(
        by, "bucket", "n",
        (F.col("vmin") + F.col("bucket") * width).alias("lo"),
        (F.col("vmin") + (F.col("bucket") + 1) * width).alias("hi"),
    )
