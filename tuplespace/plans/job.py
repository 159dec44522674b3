"""The tuple job as one lazily composed set of DataFrames.

Every attribute is a lazy DataFrame (built once per job object); only helpers that
need a stable numbering (distributed_rank) run a job while planning.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespace.config import TupleConfig
from tuplespace.operators import clean, sampling, tuples
from tuplespace.operators.gather import drop_gathered
from tuplespace.session import cut_lineage
from tuplespace.sources import testdata


class TupleJob:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: TupleConfig | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.cfg = cfg or TupleConfig()

    # inputs -----------------------------------------------------------------
    @cached_property
    def catalog(self) -> DataFrame:
        return clean.clean_catalog(testdata.catalog_raw(self.spark, self.sf_dir))

    @cached_property
    def pairs(self) -> DataFrame:
        """Written once: every later stage (label split, draws, vector filter) reads it."""
        return cut_lineage(testdata.pairs(self.spark, self.sf_dir), "pairs")

    @cached_property
    def vectors(self) -> DataFrame:
        return testdata.vectors(self.spark, self.sf_dir)

    @cached_property
    def comp(self) -> DataFrame:
        return clean.pairs_by_label(self.pairs, "1")

    @cached_property
    def neg(self) -> DataFrame:
        return clean.pairs_by_label(self.pairs, "0")

    # sampling ---------------------------------------------------------------
    @cached_property
    def draws(self) -> DataFrame:
        return sampling.similar_draws(self.comp, self.catalog, self.cfg.seed, self.cfg.exclude_self)

    @cached_property
    def sim(self) -> DataFrame:
        return self.draws.filter(F.col("item_id_2").isNotNull()).select("item_id_1", "item_id_2")

    # tuples -----------------------------------------------------------------
    @cached_property
    def joined_table(self) -> DataFrame:
        """(kind, item_id_1, item_id_2) of comp, neg and sim pairs whose items have
        vectors: one union, one pair of id joins, written once."""
        from tuplespace.operators.enrich import labelled_union, with_vector_ids

        u = with_vector_ids(labelled_union(self.comp, self.neg, self.sim), self.vectors)
        # partitioned by kind: each of the three relations reads only its folder
        return cut_lineage(u, "joined", partition_by=("kind",))

    @cached_property
    def joined(self):
        u = self.joined_table
        rel = lambda k: u.filter(F.col("kind") == k).select("item_id_1", "item_id_2")
        return rel("comp"), rel("neg"), rel("sim")

    @cached_property
    def parts(self):
        """(i,c), (i,s), (i,n), written once: ranks, distances and products read them several times."""
        comp_v, neg_v, sim_v = self.joined
        return tuple(cut_lineage(p, f"part-{r}") for p, r in zip(tuples.tuple_parts(comp_v, sim_v, neg_v), "csn"))

    @cached_property
    def fanout(self) -> DataFrame:
        comp_v, neg_v, sim_v = self.joined
        return tuples.anchor_fanout(comp_v, sim_v, neg_v)

    @cached_property
    def tuples_test(self) -> DataFrame:
        C, S, N = self.parts
        return tuples.assemble_test(C, S, N, self.cfg.seed)

    @cached_property
    def tuples_train(self) -> DataFrame:
        C, S, N = self.parts
        return tuples.assemble_train(C, S, N)

    def tuples(self, split: str) -> DataFrame:
        return self.tuples_test if split == "test" else self.tuples_train

    def materialize_tuples(self, splits=("test", "train")) -> dict[str, int]:
        """Write the assembled tuples once (the datagen output) and read later
        stages from the written tables; returns the tuple count per split."""
        counts = {}
        for split in splits:
            table = cut_lineage(self.tuples(split), f"tuples_{split}")
            self.__dict__[f"tuples_{split}"] = table
            counts[split] = table.count()
        return counts

    # vectors and scores -----------------------------------------------------
    @cached_property
    def pairs_v(self) -> DataFrame:
        """(kind, item_id_1, item_id_2, ev1, ev2): the three relations with vectors,
        joined to the vector table once as a union."""
        from tuplespace.operators.enrich import attach_vectors, labelled_union

        return attach_vectors(labelled_union(self.comp, self.neg, self.sim), self.vectors)

    @cached_property
    def pair_dist(self) -> DataFrame:
        """(kind, item_id_1, item_id_2, eu) for the three pair relations (J2 + V1): a blocked gather,
        no vector travels with a pair."""
        return self.pair_distances()

    def pair_distances(self, blocks: int | None = None) -> DataFrame:
        """The same in a given number of blocks of items (by default from the bytes of the vectors)."""
        from tuplespace.operators.enrich import labelled_union
        from tuplespace.operators.gather import blocked_distances

        pairs = labelled_union(self.comp, self.neg, self.sim)
        return blocked_distances(pairs, self.vectors, ["kind", "item_id_1", "item_id_2"], sqrt=True, blocks=blocks)

    def pair_distances_in_passes(self, blocks: int) -> DataFrame:
        """The same, written kind by kind and pass by pass: one pass's vectors are on disk at a time."""
        from tuplespace.operators.enrich import labelled_union
        from tuplespace.operators.gather import distances_in_passes

        pairs = labelled_union(self.comp, self.neg, self.sim)
        return distances_in_passes(pairs, self.vectors, ["kind", "item_id_1", "item_id_2"], "kind", sqrt=True, blocks=blocks)

    def outputs(self, layers=None) -> DataFrame:
        """Per-item tower output (normalised); ``layers=None`` = vectors as they are.

        Written once per weight set: it is per item (catalog-sized) and feeds four
        tuple joins (test) or six pair joins (train)."""
        from tuplespace.operators.tower import tower_outputs

        key = None if layers is None else hash(b"".join(w.tobytes() + b.tobytes() for w, b in layers))
        cache = self.__dict__.setdefault("_outputs", {})
        if key not in cache:
            cache[key] = cut_lineage(tower_outputs(self.vectors, layers), "outputs")
        return cache[key]

    def distances(self, split: str = "test", layers=None) -> DataFrame:
        """(i, c, s, n, d2c, d2s, d2n) for a split.

        The test split looks up the four item outputs. The train split is the
        per-anchor product; its distances are made once per distinct pair and carried
        through the product, which needs no join after it."""
        if split == "test":
            return self.row_distances(self.tuples_test, layers)
        return tuples.assemble_train(*self.part_distances(layers))

    def row_distances(self, rows: DataFrame, layers=None) -> DataFrame:
        """``rows`` (i, c, s, n and any other columns, such as a batch id) with d2c, d2s, d2n."""
        specs = [("i", "c", "d2c"), ("i", "s", "d2s"), ("i", "n", "d2n")]
        return self._output_table(layers).sq_distances(rows, specs, rows.columns)

    def part_distances(self, layers=None):
        """(i,c,d2c), (i,s,d2s), (i,n,d2n): the distances of the distinct pairs of the
        train split, written once per weight set."""
        key = None if layers is None else hash(b"".join(w.tobytes() + b.tobytes() for w, b in layers))
        cache = self.__dict__.setdefault("_part_distances", {})
        if key not in cache:
            vt = self._output_table(layers)

            def written(part, r):
                dist = vt.sq_distances(part, [("i", r, f"d2{r}")], ["i", r])
                table = cut_lineage(dist, f"dist-{r}")
                drop_gathered(dist)
                return table

            cache[key] = tuple(written(part, r) for part, r in zip(self.parts, "csn"))
        return cache[key]

    def _output_table(self, layers=None):
        from tuplespace.functions.vectors import l2_scale
        from tuplespace.operators.lookup import VectorTable

        key = None if layers is None else hash(b"".join(w.tobytes() + b.tobytes() for w, b in layers))
        tables = self.__dict__.setdefault("_out_tables", {})
        if key not in tables:
            if layers is None:  # the vectors as they are, normalised where a distance is made: half the bytes of doubles
                tables[key] = VectorTable(self.vectors.withColumn("scale", l2_scale(F.col("ev"))), "ev", "scale")
            else:
                tables[key] = VectorTable(self.outputs(layers), "out")
        return tables[key]
