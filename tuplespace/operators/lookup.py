"""Item lookups: titles of tuple items (J7) and the vector table used for distances.

``VectorTable`` is the embedding-matrix lookup of the reference as a join: the
per-item vectors that fit into one block are joined to the rows by id, more go through
the blocked gather (``operators.gather``), where no vector travels with a row; the distances
run on Arrow batches. No item matrix is collected on the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.vectors import with_sq_distances
from tuplespace.operators.gather import CELL_PAIRS, block_count, gathered_distances, tuple_rows
from tuplespace.operators.scoring import ROLES


def tuple_titles(tuples: DataFrame, titles: DataFrame) -> DataFrame:
    df = tuples
    for r in ROLES:
        df = df.join(titles.select(F.col("item_id").alias(r), F.col("title").alias(f"title_{r}")), r)
    return df


class VectorTable:
    """``scale_col``: a factor of each item's vector (its normalisation), applied where the distance is made."""

    def __init__(self, vectors: DataFrame, vec_col: str = "ev", scale_col: str | None = None):
        scale = [] if scale_col is None else [F.col(scale_col).alias("scale")]
        self.vectors, self.scaled = vectors.select("item_id", F.col(vec_col).alias("vec"), *scale), bool(scale)

    @cached_property
    def blocks(self) -> int:
        return block_count(self.vectors, "vec")

    @cached_property
    def tuple_rows(self) -> int:
        values, items = self.vectors.agg(F.sum(F.coalesce(F.array_size("vec"), F.lit(0)).cast("long")), F.count(F.lit(1))).first()
        return tuple_rows(values or 0, items)

    def sq_distances(self, df: DataFrame, specs, keep, sqrt: bool = False) -> DataFrame:
        """For each (a_id, b_id, out) add the squared (or plain, with ``sqrt``)
        distance between the two items' vectors; rows whose items have no vector
        are dropped (inner-join semantics)."""
        ids = list(dict.fromkeys(c for a, b, _ in specs for c in (a, b)))
        if self.blocks > 1:
            rows = CELL_PAIRS if len(ids) == 2 else self.tuple_rows
            return gathered_distances(df, self.vectors, specs, keep, "vec", "scale" if self.scaled else None, sqrt, self.blocks, rows)
        vec = F.transform("vec", lambda x: x.cast("double") * F.col("scale")) if self.scaled else F.col("vec")
        joined = df
        for c in ids:
            joined = joined.join(self.vectors.select(F.col("item_id").alias(c), vec.alias(f"{c}_vec")), c)
        return with_sq_distances(joined, [(f"{a}_vec", f"{b}_vec", o) for a, b, o in specs], keep, sqrt)
