"""Line dedup with levelled sorted runs of line hashes.

An index keeps, per line hash, in how many documents the line was found, as sorted
runs (Parquet, range-partitioned and sorted by hash) on levels. Documents arrive in
batches. A batch is merge-anti-joined with the runs, which drops hashes that are
settled (already found often enough), and adds the rest as its own run on level 0.
When a level has ``FANOUT`` runs they are compacted into one run of the next level.
The frequent lines are the hashes whose counts over all runs reach the threshold.
Only DataFrame functions are used.

A hash has 96 bits (a 64-bit and a 32-bit one of the key). Lines of a document are
flagged by position, so the work per document is linear in its lines; blank keys
never take part. Text crosses one shuffle, with the flags of documents that lose lines.

Cases: null or empty text is one empty line. Repeated rows are documents of their
own. A null id is an id like others. Further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespace.llm.common import WHITE_SPACE
from tuplespace.session import cut_lineage, drop_table

FANOUT = 3
BATCHES = 6
MIN_DOCUMENTS, MIN_CHARS = 10, 1

_HASH = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; the fast native lower() where there is nothing but ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_keys(text: Column) -> Column:
    """The key of every line: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE_SPACE)))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n): in ``n`` documents of the run's batches the line was found."""

    def __init__(self, spark: SparkSession, settled: int, fanout: int = FANOUT):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        run = cut_lineage(rows.repartitionByRange(*_HASH).sortWithinPartitions(*_HASH), f"run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Add a batch's (h1, h2, n), one row a hash."""
        known = self._all()
        if known is not None:
            batch = batch.join(known.where(F.col("n") >= self.settled).select(*_HASH), _HASH, "left_anti")
        self._write(batch.select(*_HASH, "n"), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        merged = old[0]
        for run in old[1:]:
            merged = merged.unionByName(run)
        self._write(merged.groupBy(*_HASH).agg(F.sum("n").alias("n")), level + 1)
        for run in old:
            drop_table(run)

    def frequent(self) -> DataFrame:
        """Hashes whose documents reach the threshold."""
        known = self._all()
        if known is None:
            return self.spark.createDataFrame([], "h1 long, h2 int")
        return known.groupBy(*_HASH).agg(F.sum("n").alias("n")).where(F.col("n") >= self.settled).select(*_HASH)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, digest, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.posexplode(line_keys(text)).alias("pos", "key"))
    return rows.where(F.length("key") >= min_chars).select(
        "doc_id", "digest", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def index_lines(docs: DataFrame, min_documents: int, min_chars: int, batches: int = BATCHES) -> LineRuns:
    """Index all lines of ``docs``, batch by batch (a hash of the id deals the documents)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = F.filter(F.array_distinct(line_keys(text)), lambda key: F.length(key) >= min_chars)
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), F.explode(keys).alias("key"))
    counted = lines.select("batch", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")).groupBy(
        "batch", *_HASH).agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted, "line-batches", partition_by=("batch",))
    runs = LineRuns(docs.sparkSession, min_documents)
    for k in range(batches):
        runs.add(counted.where(F.col("batch") == k))
    drop_table(counted)
    return runs


def drop_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = cut_lineage(index_lines(docs, min_documents, min_chars).frequent(), "frequent-lines")
    hits = _hashed_lines(docs, min_chars).join(frequent, _HASH, "left_semi")
    # Rows equal in id and text have the same lines: positions are the same, so a set will do.
    flags = hits.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("pos")).alias("gone")).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "gone")
    rows = docs.join(flags, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest")), "left")
    lines = F.split("text", "\n", -1)
    # Sorted positions become one flag a line; arrays are walked together, none is looked up by element.
    before = F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1))
    mask = F.flatten(F.zip_with(before, F.col("gone"), lambda last, at: F.concat(
        F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))))
    kept = F.array_join(F.zip_with(lines, mask, lambda line, gone: F.when(gone, F.lit(None)).otherwise(line)), "\n")
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# The same rows in DuckDB.
LINES_SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT rid, pos, line,
         trim(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCUMENTS}),
flagged AS (
  SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM flagged GROUP BY rid)
SELECT d.doc_id, k.n_lines, k.n_dropped, sha256(k.text) AS kept_sha256
FROM docs d JOIN kept k USING (rid)
"""
