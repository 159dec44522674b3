"""Mapping of the supplied tables onto the engine's inputs (see FIXTURES.md).

Ids keep the tables' BIGINT type (the operators accept string or bigint ids;
ordering "by id" follows the column type).

catalog  <- part      id = p_partkey, title = p_name, paths [p_type, p_brand] and ["NAME", p_name]
pairs    <- lineitem  one pair per row: l_partkey, the item with id l_suppkey; label '1' when
                      l_quantity <= SMALL_QUANTITY
vectors  <- embeddings  item p takes row vec_id = p_partkey % (row count of embeddings)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The literal first element of every name path; the largest quantity of
# a line whose pair counts as complementary.
NAME_PATH_ROOT = "NAME"
SMALL_QUANTITY = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as the reference reads them: asin, categories (nested list as
    JSON text), title, imUrl."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("asin"),
        F.to_json(
            F.array(F.array("p_type", "p_brand"), F.array(F.lit(NAME_PATH_ROOT), F.col("p_name")))
        ).alias("categories"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("imUrl"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs (item_id_1, item_id_2, label), one per line item: the part, the
    item whose id is the supplier's, and label '1' for a small quantity. Pairs of both
    labels grow with the line items; the few second items are hot keys."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id_1"),
        F.col("l_suppkey").alias("item_id_2"),
        F.when(F.col("l_quantity") <= SMALL_QUANTITY, F.lit("1")).otherwise(F.lit("0")).alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors (item_id BIGINT, ev ARRAY<FLOAT>) for every catalog item."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vec = emb.select(F.count(F.lit(1))).scalar()
    keyed = part.select(
        F.col("p_partkey").alias("item_id"),
        F.pmod(F.col("p_partkey"), n_vec).alias("vec_id"),
    )
    return keyed.join(emb, "vec_id").select("item_id", F.col("embedding").alias("ev"))


# DuckDB twins (used by the oracle SQL).
DUCK_CTES = {
    "catalog_raw": (
        "SELECT p_partkey AS asin, "
        f"to_json([[p_type, p_brand], ['{NAME_PATH_ROOT}', p_name]]) AS categories, "
        "p_name AS title, 'img/' || CAST(p_partkey AS VARCHAR) AS imUrl FROM part"
    ),
    "pairs": (
        "SELECT l_partkey AS item_id_1, l_suppkey AS item_id_2, "
        f"CASE WHEN l_quantity <= {SMALL_QUANTITY} THEN '1' ELSE '0' END AS label FROM lineitem"
    ),
    "vectors": (
        "SELECT p.p_partkey AS item_id, e.embedding AS ev FROM part p "
        "JOIN embeddings e ON e.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings)"
    ),
}
