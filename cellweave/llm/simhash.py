"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is cut into four segments on a ring. If two fingerprints differ in at
most three bits, the ring has a start from which every chain of 1, 2, 3 and 4
segments stays within its proportional budget: no difference in the first segment,
at most one bit in the first two, two in the first three. So equal first segments and
an equal half of the next one find every pair: eight keys of 24 bits per distinct
fingerprint. Pairs that share a key must pass the whole chain, then the full distance.

Copies share a fingerprint and are one node. Keys with many fingerprints are cut into
blocks, every pair of blocks being a small group of its own. A task keeps of its links
only a spanning forest, so a group of near copies yields fewer links than members.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; repeated rows are copies; null ids are never the least id of a group unless all
are null; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, blocks
from cellweave.llm.components import components
from cellweave.session import materialize, materialize_with

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 4
SEGMENT_BITS = 16

#: Fingerprints of one key that one group compares; larger keys are cut into blocks of about this size.
KEY_BLOCK = 2000

#: Cut keys up to this many are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 200_000

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Space-joined runs of ``size`` words, or all words if they are fewer (none: no shingle)."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit is 1 where it is set in over half of a text's shingle hashes."""
    hashes, sizes = [], []
    for text in texts:
        found = shingles(text)
        sizes.append(len(found))
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)))
    sizes = np.array(sizes, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes) * 256
    as_bytes = hashed.astype(">u8").view(np.uint8).reshape(-1, 8)
    result = np.zeros(len(texts), np.uint64)
    for k in range(8):
        counts = np.bincount(owner + as_bytes[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS_OF_BYTE
        value = np.packbits(2 * counts > sizes[:, None], axis=1)[:, 0].astype(np.uint64)
        result |= value << np.uint64(8 * (7 - k))
    return result


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(fingerprints(texts).view(np.int64))], names=["doc_id", "fp"]
        )


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a long."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_fingerprinted, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def ring_keys(nodes: DataFrame) -> DataFrame:
    """Eight keys per fingerprint: a segment with the upper or the lower half of the next."""
    keys = []
    for i in range(SEGMENTS):
        own = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
        after = F.shiftrightunsigned("fp", 16 * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for half in range(2):
            part = F.shiftrightunsigned(after, 8 * half).bitwiseAND(0xFF)
            keys.append(own * 256 + part + F.lit((2 * i + half) << 24))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs pass the chain that starts at the key's segment, and then the distance."""
    differ = (a ^ b).view(np.uint64)
    start = (key >> 25) & 3
    spent = np.zeros(len(a), np.int64)
    passed = np.ones(len(a), bool)
    for k in range(SEGMENTS):
        shift = (16 * ((start + k) % SEGMENTS)).astype(np.uint64)
        spent += _bits((differ >> shift) & np.uint64(0xFFFF))
        passed &= SEGMENTS * spent <= MAX_BITS * (k + 1)
    passed[passed] = _bits(differ[passed]) <= MAX_BITS
    return passed


class Forest:
    """A spanning forest of the links one task has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Links held by a task's forest before it starts anew.
FOREST_LINKS = 1_000_000


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each run of equal groups in batches sorted by group."""
    forest = Forest()
    kept: list[np.ndarray] = []

    def out(rows: np.ndarray):
        """rows: key, first block, second block, own block, fingerprint."""
        nonlocal forest
        at = np.arange(len(rows))
        shift = 1
        while True:
            at = at[at + shift < len(rows)]
            at = at[(rows[at, :3] == rows[at + shift, :3]).all(axis=1)]
            if not len(at):
                return
            # between two blocks only, or within one
            pairs = at[(rows[at, 1] == rows[at, 2]) | (rows[at, 3] != rows[at + shift, 3])]
            a, b = rows[pairs, 4], rows[pairs + shift, 4]
            passed = linked(a, b, rows[pairs, 0])
            new = [(x, y) for x, y in zip(a[passed].tolist(), b[passed].tolist()) if forest.add(x, y)]
            if new:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in new], "b": [y for _, y in new]})
            if len(forest.parent) > FOREST_LINKS:
                forest = Forest()
            shift += 1

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not len(rows):
            continue
        rows = np.concatenate([*kept, rows])
        # the last group may go on in the next batch
        cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        kept = [rows[cut:]]
        yield from out(rows[:cut])
    if kept:
        yield from out(kept[0])


def near_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within ``MAX_BITS`` of each other."""
    keyed = ring_keys(nodes)
    sizes, totals = materialize_with(
        keyed.groupBy("key").count().filter(F.col("count") > KEY_BLOCK).select(
            "key", F.ceil(F.col("count") / KEY_BLOCK).cast("int").alias("parts")
        ),
        "large-keys",
        n=F.count(F.lit(1)),
    )
    if totals["n"]:
        keyed = keyed.join(F.broadcast(sizes) if totals["n"] <= BROADCAST_KEYS else sizes, "key", "left")
    else:
        keyed = keyed.withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = keyed.withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    groups = placed.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
    return (
        groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_compared, "a long, b long")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``fingerprint`` as hex digits and ``component_id``."""
    prints = materialize(simhash(docs, doc_id, text), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = components(near_links(nodes))
    rooted = nodes.join(groups, nodes.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
