"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bin_slack, length_histogram, license_fuzzy, line_rules, minimax_shards, nbsvm, ngram_decontam, simhash_ring, token_orc, wrapper_html
from .pieces import tokenizer_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.digest(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_table(spark, sf_dir, "documents"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.with_suffix_sums(length_histogram.histogram(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)))


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.digest(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op5_ngram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.assign(_table(spark, sf_dir, "documents"))


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.main_texts(_table(spark, sf_dir, "pages"))


def op9_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.digest(_table(spark, sf_dir, "documents"))


def op10_license_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_fuzzy.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_token_orc, op2_line_rules, op3_length_histogram, op4_bin_slack, op5_ngram_decontam, op6_nbsvm, op7_minimax_shards, op8_wrapper_text, op9_simhash_ring, op10_license_fuzzy]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_rules": line_rules.SQL, "op5_ngram_decontam": ngram_decontam.SQL}
