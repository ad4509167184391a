"""A training-corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of every near-duplicate group stays, contaminated
documents go, secrets are replaced in the texts, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, decontaminate, secrets, simhash, toxicity
from cellweave.llm.common import read_table
from cellweave.session import materialize, materialize_with

#: Digests of contaminated texts up to this many are broadcast; beyond it the join shuffles.
BROADCAST_TEXTS = 100_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the stage's input that are not held out."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").filter(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), model, into="toxic_score").filter(
        F.col("toxic_score") < toxicity.TOXIC
    ).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text, so one row stays where an id is repeated; null ids come last."""
    key = F.struct(F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    keyed = docs.select(key.alias("doc_id"), "text")
    groups = simhash.near_duplicates(keyed).filter(F.col("doc_id") == F.col("component_id"))
    first, seen = materialize_with(
        groups.groupBy(F.col("doc_id").alias("first")).agg(F.count("*").alias("n")),
        "first",
        repeated=F.count_if(F.col("n") > 1),
    )
    kept = docs.select(*COLUMNS, key.alias("row")).join(first, F.col("row") == F.col("first"), "left_semi")
    if seen["repeated"]:  # whole rows that occur again
        kept = kept.dropDuplicates(["row"])
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is judged by its text; equal texts have equal verdicts, so they are joined by a digest of the text."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select(digest.alias("doc_id"), "text")
    tests = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    contaminated = decontaminate.contamination(keyed, tests).filter("contaminated")
    bad, seen = materialize_with(contaminated.select(F.col("doc_id").alias("bad")).distinct(), "bad", n=F.count(F.lit(1)))
    if seen["n"] <= BROADCAST_TEXTS:
        bad = F.broadcast(bad)
    return docs.select(*COLUMNS, digest.alias("digest")).join(bad, F.col("digest") == F.col("bad"), "left_anti").select(*COLUMNS)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", replace_secrets),
    ("byte-level BPE", encode),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
