"""Registered queries of the corpus operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tuplespace.llm.common import read_table
from tuplespace.llm.conversations import repair_report
from tuplespace.llm.decontam import contaminated
from tuplespace.llm.kdshards import shard_report
from tuplespace.llm.langid import identify_languages
from tuplespace.llm.lines import LINES_SQL, line_report
from tuplespace.llm.minhash import near_duplicates
from tuplespace.llm.mixing import mix_report
from tuplespace.llm.nbsvm import score_quality
from tuplespace.llm.onebit import nearest
from tuplespace.llm.periodic import collapse_runs
from tuplespace.llm.suffix_dedup import repeated_passages
from tuplespace.llm.token_orc import tokenize_documents
from tuplespace.llm.urls import filter_urls, urls_sql


def word_tokenizer() -> str:
    """Place of the public tokenizer file of the contract (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(read_table(spark, sf_dir, "documents"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_documents(spark, read_table(spark, sf_dir, "documents"), word_tokenizer())


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(read_table(spark, sf_dir, "documents"))


def op13_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit": op1_one_bit,
    "op2_langid": op2_langid,
    "op3_kd_shards": op3_kd_shards,
    "op4_line_runs": op4_line_runs,
    "op5_minhash": op5_minhash,
    "op6_url_ratio": op6_url_ratio,
    "op7_decontam": op7_decontam,
    "op8_token_orc": op8_token_orc,
    "op9_suffix_array": op9_suffix_array,
    "op10_mixing": op10_mixing,
    "op11_viterbi_repair": op11_viterbi_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_nbsvm": op13_nbsvm,
}

ORACLE: dict[str, str] = {
    "op4_line_runs": LINES_SQL,
    "op6_url_ratio": urls_sql(),
}
