"""Attach item vectors to pairs (the reference joins the vectors six times)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("comp", "neg", "sim")


def attach_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Inner joins on both ids -> (…, ev1, ev2); a pair whose item lacks a vector goes."""
    v1 = vectors.select(F.col("item_id").alias("item_id_1"), F.col("ev").alias("ev1"))
    v2 = vectors.select(F.col("item_id").alias("item_id_2"), F.col("ev").alias("ev2"))
    return pairs.join(v1, "item_id_1").join(v2, "item_id_2")


def labelled_union(comp: DataFrame, neg: DataFrame, sim: DataFrame) -> DataFrame:
    """The three pair relations in one frame with a ``kind`` column, so the vectors
    are joined (and shuffled) once for all three."""
    return (
        comp.select("item_id_1", "item_id_2", F.lit("comp").alias("kind"))
        .unionByName(neg.select("item_id_1", "item_id_2", F.lit("neg").alias("kind")))
        .unionByName(sim.select("item_id_1", "item_id_2", F.lit("sim").alias("kind")))
    )


def with_vector_ids(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keep pairs whose two items have a vector (inner join on the id column only,
    so the vector payload is not moved and duplicate vector ids still multiply)."""
    ids = vectors.select("item_id")
    return pairs.join(ids.withColumnRenamed("item_id", "item_id_1"), "item_id_1").join(
        ids.withColumnRenamed("item_id", "item_id_2"), "item_id_2"
    )
