"""Catalog cleaning and label split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.text import clean_title

CATALOG_COLUMNS = ("asin", "categories", "title", "imUrl")


def drop_incomplete(df: DataFrame, cols=CATALOG_COLUMNS) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Project the four used columns, newline -> space in title, drop rows null in
    any of them, full-row distinct (an id with two titles stays twice)."""
    df = raw.select(*CATALOG_COLUMNS).withColumn("title", clean_title(F.col("title")))
    return drop_incomplete(df).distinct()


def pairs_by_label(pairs: DataFrame, label: str) -> DataFrame:
    """'1' = complementary, '0' = negative; other labels belong to neither."""
    return pairs.filter(F.col("label") == F.lit(label)).select("item_id_1", "item_id_2")
