"""Connected components of a link table, by contraction: no link or label leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.session import cut_lineage, drop_table


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    """(v, p): the smaller of v and its smallest neighbour, for every v that has one."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("o")).union(
        links.select(F.col("b").alias("v"), F.col("a").alias("o")))
    return both.groupBy("v").agg(F.min("o").alias("p")).select("v", F.least("v", "p").alias("p"))


def _follow(pairs: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Replace ``key`` by its parent where it has one."""
    step = parents.select(F.col("v").alias(key), F.col("p").alias("_p"))
    return pairs.join(step, key, "left").withColumn(key, F.coalesce("_p", key)).drop("_p")


def component_labels(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links`` (a, b) with the smallest node it reaches.

    Each round hooks every remaining node to its smallest neighbour, shortens the
    resulting trees by pointer jumping, and keeps only links between different trees,
    so at least half of the nodes that still have links go in each round. The round's
    tables are written to the shared checkpoint folder; the driver sees row counts."""
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        parents = _smallest_neighbour(links)
        parents = cut_lineage(_follow(_follow(parents, "p", parents), "p", parents), "parents")
        while True:  # until every parent is a root
            roots = parents.where("v = p").select(F.col("v").alias("p"))
            if parents.join(roots, "p", "left_anti").isEmpty():
                break
            parents = cut_lineage(_follow(_follow(parents, "p", parents), "p", parents), "parents")
        if labels is None:
            labels = parents.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            labels = cut_lineage(_follow(labels, "component", parents), "labels")
        next_links = _follow(_follow(links, "a", parents), "b", parents).where("a <> b")
        next_links = cut_lineage(
            next_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        drop_table(links)
        links = next_links
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", "component")
