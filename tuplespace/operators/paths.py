"""Category-path index: path -> distinct items, kept exploded (never collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.text import parse_paths
from tuplespace.operators.ranks import distributed_rank, group_spans


def path_index(catalog: DataFrame) -> DataFrame:
    """(path, item_id) distinct; empty paths are dropped by parse_paths."""
    return catalog.select(
        F.explode(parse_paths(F.col("categories"))).alias("path"), F.col("asin").alias("item_id")
    ).distinct()


def path_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("path").agg(F.count(F.lit(1)).alias("n_items"))


def ranked_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items ranked by (path, item_id) globally, and per path (start, n).

    The k-th member of a path (0-based) has global rank start + k, so a draw
    becomes an equi-join on one unique bigint instead of a scan of the path.
    """
    ranked = distributed_rank(index, ["path", "item_id"], "grank")
    return ranked, group_spans(ranked, "path")
