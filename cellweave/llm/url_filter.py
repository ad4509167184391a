"""URL filters: a blocked Bloom filter in front of an exact join.

A URL stands for its canonical expressions: every suffix of its host, joined with
every prefix of its path that could be a rule's path, and its own canonical form. All
listed entries, rules and URLs alike, are hashed into a Bloom filter whose keys touch
one 256-bit block each. Expressions that pass the filter are joined exactly with the
list, so false positives have no effect; the longest rule of a page wins, and a page
without a rule is blocked if its canonical URL is listed.

The filter's size is a parameter, so it can be broadcast however long the list is; a
long list only sends more expressions to the join.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no
rule and is allowed; repeated pages and ids are kept, each with its verdict; an empty
table gives an empty result and an empty list allows everything. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import lower_ascii
from cellweave.session import materialize

#: Blocks of 256 bits: 2 MB.
BLOCKS = 1 << 16
WORDS = 4


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a default host label, file ending or closing slash; empty for no host."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.regexp_replace(host, r"^www\.", ""), bare, F.lit("#url")))


def _places(entry: Column) -> tuple[Column, list[Column]]:
    """The block of an entry and one 64-bit mask for each of the block's words."""
    h = F.xxhash64(entry)
    block = F.pmod(h, F.lit(BLOCKS)).cast("int")
    more = F.xxhash64(entry, F.lit(1))
    masks = []
    for w in range(WORDS):
        bit = F.shiftrightunsigned(more, 6 * w).bitwiseAND(63).cast("int")
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return block, masks


def bloom_table(entries: DataFrame) -> np.ndarray:
    """The filter as ``BLOCKS`` rows of ``WORDS`` longs, put together from at most one row per block."""
    block, masks = _places(F.col("entry"))
    rows = (
        entries.select(block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        .collect()
    )
    table = np.zeros((BLOCKS, WORDS), np.int64)
    for r in rows:
        table[r.block] = [r[f"w{i}"] for i in range(WORDS)]
    return table


def _passing(bloom):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for batch in batches:
            block = batch.column(2).to_numpy()
            hit = np.ones(len(block), bool)
            for w in range(WORDS):
                mask = batch.column(3 + w).to_numpy()
                hit &= (table[block, w] & mask) == mask
            yield batch.select([0, 1]).filter(pa.array(hit))

    return check


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Suffixes of the host at label borders, each with the prefixes of the path of the given lengths; and the canonical URL."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.array_compact(
        F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)).cast("array<string>")
    )
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(rules, F.array(canonical(host, path)))))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, the rule that decides and the verdict.

    ``rules`` has ``rule`` (host and path prefix, like ``example.net/en/``) and
    ``verdict``; ``listed`` has blocked canonical URLs as ``entry``.
    """
    spark = pages.sparkSession
    path_length = F.length("rule") - F.instr("rule", "/") + 1
    lengths = sorted(r[0] for r in rules.filter(F.instr("rule", "/") > 0).select(path_length).distinct().collect())
    read = materialize(
        pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pages",
    )
    entries = materialize(
        rules.select(F.col("rule").alias("entry"), "verdict", F.lit(True).alias("is_rule"))
        .unionByName(listed.select("entry").distinct().select("entry", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))),
        "listed",
    )
    bloom = spark.sparkContext.broadcast(bloom_table(entries))
    asked = read.select("row", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("entry"))
    block, masks = _places(F.col("entry"))
    hashed = asked.select("row", "entry", block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    possible = hashed.mapInArrow(_passing(bloom), "row long, entry string")
    sure = possible.join(entries, "entry")
    rule = F.when(F.col("is_rule"), F.struct(F.length("entry").alias("n"), "entry", "verdict"))
    decided = sure.groupBy("row").agg(F.max(rule).alias("rule"), F.max(F.when(~F.col("is_rule"), F.col("verdict"))).alias("listed"))
    return read.join(decided, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("rule.entry").alias("rule"),
        F.coalesce("rule.verdict", "listed", F.lit("allow")).alias("verdict"),
    )
