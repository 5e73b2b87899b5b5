"""A cleaning pipeline over the documents: STAGES, and run(), which applies them in order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents; run() writes each result as Parquet and reads it back for the next stage. Rows without
an id cannot be addressed by a decision and stay; rows that share an id share its decisions. A null
text is empty, an empty table stays empty, texts are treated whole; columns besides doc_id, text, lang
and n_chars are carried along untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpanel.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from flowpanel.llm.common import cut, release

# SQL cannot express the stages (calibrated cutoffs, MinHash, tokenization); tests use brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """`docs` without the rows whose id is in `ids`; a decision is computed once, then joined."""
    gone = cut(ids.select("doc_id").where("doc_id is not null").distinct(), name)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; cutoffs come from the labels of the documents.

    The base rules reject documents without words, null and empty texts among them.
    """
    stats = cut(quality_rules.statistics(docs), "pipeline-statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cutoffs = cut(quality_rules.thresholds(stats, labels), "pipeline-cutoffs")
    return _without(docs, quality_rules.apply_rules(stats, cutoffs).where(~F.col("kept")), "pipeline-rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go; n_chars follows the text.

    A document that had lines and loses all of them goes, as they stand in the documents that keep
    them. Documents without a word stay as they are. Null texts, empty tables and rows without an id
    pass through; rows that repeat an id lose the same lines.
    """
    kept = line_dedup.dedup(docs)
    left = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.where((F.col("n_removed") == 0) | left)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents, the one with the least id stays; so do those without a word."""
    return _without(docs, ngram_join.join(docs).where("component_id <> doc_id"), "pipeline-duplicates")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.search(docs, items), "pipeline-contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and the digest of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode_rows(docs, path, public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", benchmark),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
