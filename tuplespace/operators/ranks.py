"""Global rank without a one-task window.

``row_number() over (order by k)`` without a partition clause moves every row into a
single task. Here the rows are range-partitioned on the key, sorted inside each
partition, numbered locally, and shifted by the row count of all earlier partitions.
The only unpartitioned window runs over the P per-partition counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.session import cut_lineage, drop_table


def distributed_rank(
    df: DataFrame,
    order_cols: list[str],
    rank_col: str = "grank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col``: the 0-based position of each row in ``order_cols`` order.

    The key is expected to be unique (ties get distinct but arbitrary ranks). The
    numbered rows (with their partition id and local number) are written to the
    shared checkpoint folder so that both passes (counts and numbering) see the same
    rows, also after an executor is lost.
    """
    # Without an explicit count AQE sizes the range partitions by bytes (it merges
    # adjacent ranges, which keeps them in order); a count pins them (tests).
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    numbered = (
        ranged
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn(
            "_loc",
            F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33),
        )
    )
    numbered = cut_lineage(numbered, "rank")
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    # offsets has one row per partition: bounded by the partition count.
    ranked = (
        numbered.join(F.broadcast(offsets), "_pid")
        .withColumn(rank_col, F.col("_off") + F.col("_loc"))
        .drop("_pid", "_loc", "_off")
    )
    ranked._ranked_from = numbered
    return ranked


def keep_ranked(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """``df``, made from ``ranked``, remembers the written rows behind it for :func:`drop_ranked`."""
    df._ranked_from = ranked._ranked_from
    return df


def drop_ranked(df: DataFrame) -> None:
    """Delete the numbered rows behind a ranked table (no further use of it)."""
    drop_table(df._ranked_from)


def group_spans(ranked: DataFrame, group_col: str, rank_col: str = "grank") -> DataFrame:
    """Per group: first global rank and size (partial aggregation, skew safe)."""
    return ranked.groupBy(group_col).agg(
        F.min(rank_col).alias("start"), F.count(F.lit(1)).alias("n")
    )


def running_totals(df: DataFrame, order_col: str, cols: list[str], suffix: str = "_cum") -> DataFrame:
    """Cumulative sums of ``cols`` in ``order_col`` order without a one-task window:
    range partitions get local running sums, shifted by the totals of all earlier
    partitions (a window over P rows only)."""
    tagged = cut_lineage(
        df.repartitionByRange(order_col).withColumn("_pid", F.spark_partition_id()), "running"
    )
    local = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    with_local = tagged.withColumns({f"_l_{c}": F.sum(c).over(local) for c in cols})
    totals = tagged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols]
    )
    out = with_local.join(F.broadcast(offsets), "_pid")
    out = out.withColumns({f"{c}{suffix}": F.col(f"_o_{c}") + F.col(f"_l_{c}") for c in cols})
    return out.drop("_pid", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols])
