"""Quality rules judged by host.

Each document is measured once. Rule failures are added up by host, every host's
rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts
themselves (method of moments), and the host's verdict is joined back: all documents
of a host that fails a rule too often are rejected.

Defined cases: a null text has no words and fails the base rule; a null host is a
host of its own; repeated rows and repeated ids are kept and counted as rows; an
empty table gives an empty result. Input columns other than the three named are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import texts_of
from cellweave.session import materialize, materialize_with

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50

#: A host fails a rule if the shrunken share of its documents that fail it is above this.
MAX_RATE = 0.5

#: Hosts up to this many are broadcast; beyond it the join shuffles.
BROADCAST_HOSTS = 200_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    base = len(seen)
    pairs = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:  # keeps the window's code below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    window = pairs[:-1] * base + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(words), bool)
    first = np.concatenate((order[1:][same], order[:-1][same]))
    for shift in range(3):
        hit[first + shift] = True
    return int(hit.sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes split at the six ASCII spaces only
    chars = text.decode("utf-8", "replace")
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(chars) - sum(map(chars.count, SPACES)),
        sum(map(chars.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measures(t) for t in texts_of(batch.column(2))], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(len(MEASURES)))],
            names=["doc_id", "host", *MEASURES],
        )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def document_rules() -> dict[str, Column]:
    """The rules a document can fail, each counted by host."""
    return {
        "base": F.col("base_failed"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 20 * F.col("n_dup_lines") > F.col("n_words"),
    }


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Parameters of a beta distribution with the mean and spread of the hosts' failure rates.

    Half a failure and half a pass are added to each host, so no rate is 0 or 1.
    With fewer than two hosts, or no spread, the prior weighs as much as two documents.
    """
    rate = (F.col(rule) + 0.5) / (F.col("n_docs") + 1.0)
    row = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.count("*").alias("n")).first()
    if not row.n:
        return 1.0, 1.0
    weight = row.m * (1 - row.m) / row.v - 1 if row.n > 1 and row.v and row.v > 0 else 2.0
    weight = max(weight, 2.0)
    return row.m * weight, (1 - row.m) * weight


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: measures, ``base_failed``, the host's shrunken ``host_rate`` and ``kept``."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    schema = f"doc_id {id_type}, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = materialize(read.mapInArrow(_measured, schema).withColumn("base_failed", base_failed()), "host-measures")

    rules = document_rules()
    hosts, totals = materialize_with(
        measured.groupBy("host").agg(
            F.count("*").alias("n_docs"), *(F.sum(F.when(c, 1.0).otherwise(0.0)).alias(r) for r, c in rules.items())
        ),
        "hosts",
        n=F.count(F.lit(1)),
    )
    rates = []
    for rule in rules:
        a, b = beta_prior(hosts, rule)
        rates.append((F.col(rule) + a) / (F.col("n_docs") + a + b))
    verdicts = hosts.select(F.col("host").alias("judged"), F.greatest(*rates).alias("host_rate"))
    if totals["n"] <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    return measured.join(verdicts, measured.host.eqNullSafe(verdicts.judged), "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= MAX_RATE)).alias("kept"), "host_rate"
    )
