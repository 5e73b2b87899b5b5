"""The registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpanel.llm import (
    bpe, chat_format, decontaminate, importance, license_scan, line_dedup, ngram_join, oracles, prefix_trie, quality_rules, secret_scan, suffix_dedup,
    token_files, url_filter,
)
from flowpanel.llm.common import cut, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), digests=True)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    parts = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder, END_ID)
    return token_files.read_tokens(parts, folder)


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_rows(documents(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = cut(quality_rules.statistics(documents(spark, sf_dir)), "quality-statistics")
    cutoffs = cut(quality_rules.thresholds(stats, labels), "quality-cutoffs")
    return quality_rules.apply_rules(stats, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


ORACLES["op9_decontaminate"] = oracles.DECONTAMINATE


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages, url_filter.labelled_urls(spark))


ORACLES["op11_prefix_trie"] = oracles.PREFIX_TRIE


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digests(prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLES["op12_importance_resampling"] = oracles.IMPORTANCE


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = importance.resample(documents(spark, sf_dir), target)
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


ORACLES["op13_chat_format"] = oracles.CHAT_FORMAT
HARD_TURN = "\\### Assistant: </turn> ok"


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(convs.unionByName(hard)))
