"""Similar-item sampling: one reproducible draw per complementary row.

For a complementary row (a, c) the anchor's paths are sorted by text and one is
chosen by hash(seed, a, c, 'path'); inside that path one member is chosen by
hash(seed, a, c, 'item'). The member lookup is an equi-join on the global rank of
(path, item_id), so no path is ever expanded next to its anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.functions.hashing import draw_hash, pick
from tuplespace.functions.text import parse_paths
from tuplespace.operators.paths import path_index, ranked_index


def anchor_catalog(comp: DataFrame, catalog: DataFrame) -> DataFrame:
    """Complementary rows joined to the anchor's catalog rows (inner; a catalog id
    with two distinct rows gives two rows)."""
    cat = catalog.select(F.col("asin").alias("item_id_1"), "categories")
    return comp.select("item_id_1", "item_id_2").join(cat, "item_id_1")


def _drawn_paths(comp: DataFrame, catalog: DataFrame, seed: str) -> DataFrame:
    rows = anchor_catalog(comp, catalog).withColumn("paths", parse_paths(F.col("categories")))
    k = pick(draw_hash(seed, F.col("item_id_1"), F.col("item_id_2"), "path"), F.size("paths"))
    return rows.select(
        "item_id_1",
        F.col("item_id_2").alias("comp_id"),
        F.when(k.isNotNull(), F.element_at("paths", (k + 1).cast("int"))).alias("path"),
    )


def similar_draws(
    comp: DataFrame, catalog: DataFrame, seed: str = "0", exclude_self: bool = False
) -> DataFrame:
    """All draw rows (item_id_1, comp_id, path, item_id_2); item_id_2 is null when the
    anchor has no usable path (or, with exclude_self, its path has only itself)."""
    draws = _drawn_paths(comp, catalog, seed)
    ranked, spans = ranked_index(path_index(catalog))
    with_span = draws.join(spans, "path", "left")
    h = draw_hash(seed, F.col("item_id_1"), F.col("comp_id"), "item")
    if not exclude_self:
        target = F.col("start") + pick(h, F.col("n"))
    else:
        own = ranked.select(
            "path", F.col("item_id").alias("item_id_1"), F.col("grank").alias("own_rank")
        )
        with_span = with_span.join(own, ["path", "item_id_1"], "left")
        r = F.col("start") + pick(h, F.col("n") - 1)
        target = r + F.when(r >= F.col("own_rank"), 1).otherwise(0)
    members = ranked.select(F.col("grank").alias("target"), F.col("item_id").alias("item_id_2"))
    return (
        with_span.withColumn("target", target)
        .join(members, "target", "left")
        .select("item_id_1", "comp_id", "path", "item_id_2")
    )


def sample_similar(
    comp: DataFrame, catalog: DataFrame, seed: str = "0", exclude_self: bool = False
) -> DataFrame:
    """The similar relation (item_id_1 = anchor, item_id_2 = similar item)."""
    return similar_draws(comp, catalog, seed, exclude_self).filter(
        F.col("item_id_2").isNotNull()
    ).select("item_id_1", "item_id_2")


def unresolved_anchors(draws: DataFrame) -> DataFrame:
    """Reject table: draw rows that found no similar item."""
    return draws.filter(F.col("item_id_2").isNull()).select("item_id_1", "comp_id", "path")
