"""A corpus pipeline: rules, classifier, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs. A row
without doc_id cannot be named by a verdict on ids and stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelock.llm import bin_slack, line_rules, nbsvm, ngram_decontam, simhash_ring
from tidelock.llm.common import clear, materialize, without_ids
from tidelock.llm.pieces import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that fail the base rules or are depleted."""
    return without_ids(docs, line_rules.judge(docs).where(~F.col("kept")).select("doc_id"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a score of 0.7 or more. The model is fitted on labelled rows of docs, so on what the rules kept."""
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(nbsvm.score(F.col("text"), model) >= nbsvm.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the least doc_id of each component of texts similar to 0.8 or more (five words a shingle); of rows that repeat a doc_id, one."""
    found = simhash_ring.near_copies(docs)
    kept = without_ids(docs, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("_again")), "repeated")
    if repeated.limit(1).count():
        again = kept.join(repeated, kept["doc_id"] == repeated["_again"], "left_semi").dropDuplicates(["doc_id"])
        kept = without_ids(kept, repeated).unionByName(again)
    return kept


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item."""
    found = ngram_decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, found.where("contaminated").select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return bin_slack.digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]
#: The classifier and the fingerprints are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, keep=docs)
    return docs
