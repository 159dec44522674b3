"""The corpus pipeline over ``documents``, stage by stage; each stage's rows are written and reread.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All stages but the last return the columns of ``docs``. No stage reads what an earlier one dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespace.llm.common import free_prefix, read_table
from tuplespace.llm.decontam import decontaminate
from tuplespace.llm.langid import UNKNOWN, train_language_model
from tuplespace.llm.minhash import kept_rows, linked_rows, rows_without_id
from tuplespace.llm.mixing import mix
from tuplespace.llm.queries import word_tokenizer
from tuplespace.llm.token_orc import tokenize_documents
from tuplespace.session import cut_lineage

# A document whose best language has a calibrated probability under this is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters and undecided ones go.

    Null and empty texts go, repeated rows and null ids are judged by their text; without
    any labelled row all go. The prediction stands beside columns of any name."""
    own = free_prefix(docs.columns)
    lang, score = own + "lang", own + "score"
    predicted = train_language_model(docs).predict(docs, (lang, score))
    return predicted.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Of rows that repeat that id one stays, of a group without any id one row."""
    linked = linked_rows(docs)
    if docs.where("doc_id IS NULL").isEmpty():
        return _rows_with_id(docs, linked)
    linked = cut_lineage(linked, "linked")
    return _rows_with_id(docs.where("doc_id IS NOT NULL"), linked).unionByName(rows_without_id(docs, linked))


def _rows_with_id(docs: DataFrame, linked: DataFrame) -> DataFrame:
    gone = kept_rows(linked).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    ids = cut_lineage(ids, "repeated-ids")
    if ids.isEmpty():  # as in any table with a key: no second shuffle of the texts
        return left
    once = left.join(ids, left["doc_id"] == ids["_id"], "left_semi").dropDuplicates(["doc_id"])
    return left.join(ids, left["doc_id"] == ids["_id"], "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the ``benchmark`` table.

    Null and empty texts hold none and stay; rows that repeat an id, null ids among them, go together."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, one row for each time it takes them.

    Documents without a word weigh nothing and aren't taken. A null source is a source. Rows equal in id, source
    and text share their copies. Columns of any name pass through."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, written as ORC; one row per document read back from the files.

    Null ids come first, a null text is its end id alone, repeated rows all stay. Further columns aren't read."""
    return tokenize_documents(spark, docs, word_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_orc", token_output),
]

# The stages fit models, link near copies and encode tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
