"""The operators bound to the given tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import (
    bpe,
    collocations,
    context_tree,
    conversations,
    decontaminate,
    host_rules,
    licenses,
    quality,
    secrets,
    simhash,
    token_counts,
    toxicity,
    url_filter,
)
from cellweave.llm.common import read_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The host and path rules, and the names of hosts whose URLs are listed.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), PIECES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    tests = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(docs, tests).drop("n_near")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("host_rate")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.judge(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on hosts with a listed name."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    named = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_NAMES)))
    return pages.filter(named).select(url_filter.canonical(host, path).alias("entry"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES.items()), "rule string, verdict string")
    return url_filter.judge(pages, rules, listed_urls(pages))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judge(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(collocations.collocations(read_table(spark, sf_dir, "documents", "text", "lang")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.report(given.select(F.col("conv_id").alias("conv")), conversations.damaged(given))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontamination,
        op3_host_rules,
        op4_toxicity,
        op5_simhash,
        op6_licenses,
        op7_context_tree,
        op8_url_filter,
        op9_secrets,
        op10_byte_bpe,
        op11_quality,
        op12_collocations,
        op13_conversation_repair,
    )
}
