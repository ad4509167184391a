"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the preceding
bytes from the last backwards, down to ``DEPTH``. A node's counts of zeros and ones
give a Krichevsky-Trofimov estimate; its weighted probability is half its own estimate
and half the product of its children's. The share of the own half is what the node's
estimate weighs against longer contexts in a prediction. Every node that has seen two
decisions is kept, in written tables; a node that has seen one is a leaf.

No task holds the tree. The texts are cut into blocks, and every block counts its
distinct grams. Grams and nodes that share their last two context bytes meet in one
task, which works out the grams' probabilities (at most 2^24 grams have these bytes in
common); nodes of shorter contexts, at most 255 * 257, are broadcast. The
probabilities then meet the blocks that asked for them.

A text is its lower-cased bytes and an end byte; its score is the sum of the log10
probabilities of these, and the code length per byte is that in bits, negated.

The base score beside it is a unigram over words. Words among the ``COMMON`` most
frequent ones are looked up in the task; the others are counted and joined by Spark.

Defined cases: null and empty texts are an end alone; a null id is held out; repeated
rows and ids are kept, each with its score; without training texts every word has the
same probability and every bit an even one; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, blocks, id_remainder, texts_of
from cellweave.session import materialize, materialize_with

DEPTH = 4
END = 0

#: Decisions a node must have seen to be kept.
LEAST = 2

#: Words whose counts are sent to every task.
COMMON = 100_000

#: Distinct words a task counts before it hands them on.
COUNTED_WORDS = 200_000

#: Bytes of text whose grams are counted, and that are scored, at once.
COUNTED_BYTES = 2 << 20
SCORED_BYTES = 1 << 20

#: Entries of a task's store of byte probabilities.
STORED_GRAMS = 1 << 19

#: A block of texts that are scored together ends at this many bytes, or grams counted in its pieces.
BLOCK_BYTES = 32 << 20
BLOCK_GRAMS = 8 << 20

#: Distinct grams whose probabilities are worked out in one group, on average, and at once.
GROUP_GRAMS = 200_000
TREE_GRAMS = 500_000


def held_out(doc_id: str = "doc_id") -> Column:
    return id_remainder(doc_id, 10) == 0


def grams(texts: list[bytes]) -> np.ndarray:
    """For every byte of the texts and their ends: the ``DEPTH`` bytes before it and itself, as one number.

    The byte is the lowest eight bits, the last context byte the next eight. Before a
    text stand end bytes.
    """
    pad = bytes([END]) * DEPTH
    joined = np.frombuffer(pad + b"".join(t.translate(LOWER) + pad for t in texts), np.uint8).astype(np.int64)
    n = len(joined) - DEPTH
    code = joined[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        code |= joined[DEPTH - k : DEPTH - k + n] << (8 * k)
    if not texts:
        return code[:0]
    # of the end bytes after a text only the first is its own
    held = np.ones(n, bool)
    ends = np.cumsum([len(t) + DEPTH for t in texts])
    for k in range(1, DEPTH):
        held[ends - k] = False
    return code[held]


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"]
        )

    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(text.translate(LOWER).split())
        if len(counts) > COUNTED_WORDS:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in blocks(batches, 0, COUNTED_BYTES):
        code, n = np.unique(grams(texts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])


BLOCKS = "doc_id {id}, row long, block long, text binary, gram long, n long"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all parts with their summed counts."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n[order], first)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``(doc_id, row, block, text)`` and, for each block, its grams with their counts in training texts."""
    row = block = TaskContext.get().partitionId() << 40
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def batch(count: int, **columns: pa.Array) -> pa.RecordBatch:
        types = {"doc_id": id_type, "row": pa.int64(), "block": pa.int64(), "text": pa.binary(), "gram": pa.int64(), "n": pa.int64()}
        arrays = [columns.get(c, pa.nulls(count, t)) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(types))

    def counted() -> Iterator[pa.RecordBatch]:
        code, n = _merged(parts)
        for lo in range(0, len(code), 100_000):
            some = code[lo : lo + 100_000]
            at = pa.array(np.full(len(some), block))
            yield batch(len(some), block=at, gram=pa.array(some), n=pa.array(n[lo : lo + 100_000]))

    for rows, texts in blocks(batches, 1, COUNTED_BYTES):
        id_type = rows.column(0).type
        more = sum(map(len, texts))
        if parts and (size + more > BLOCK_BYTES or sum(len(c) for c, _ in parts) > BLOCK_GRAMS):
            yield from counted()
            block, size, parts = block + 1, 0, []
        size += more
        held = rows.column(2).to_pylist()
        for out in (False, True):
            code, n = np.unique(grams([t for t, h in zip(texts, held) if h == out]), return_counts=True)
            parts.append((code, np.zeros_like(n) if out else n))
        count = len(texts)
        at = pa.array(np.full(count, block))
        yield batch(count, doc_id=rows.column(0), row=pa.array(np.arange(row, row + count)), block=at, text=pa.array(texts, pa.binary()))
        row += count
    if parts:
        yield from counted()


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; x is at least a half."""
    z = x + 8
    back = F.log(x)
    for k in range(1, 8):
        back = back + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - back


def log_estimate(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = zeros.cast("double"), ones.cast("double")
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _decisions(counted: DataFrame) -> DataFrame:
    """Nodes of full depth: the context, the bits of the byte so far behind a leading 1, zeros and ones."""
    byte = F.col("gram").bitwiseAND(255).cast("int")
    context = F.shiftright("gram", 8)
    bits = F.array(
        *(
            F.struct(
                F.shiftright(byte, 8 - k).bitwiseOR(1 << k).alias("bits"),
                F.shiftright(byte, 7 - k).bitwiseAND(1).alias("bit"),
            )
            for k in range(8)
        )
    )
    return (
        counted.select(context.alias("context"), "n", F.explode(bits).alias("d"))
        .groupBy("context", F.col("d.bits").alias("bits"))
        .agg(
            F.sum(F.when(F.col("d.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("d.bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
        )
    )


def tree_nodes(texts: DataFrame) -> DataFrame:
    """The kept nodes of the texts."""
    counted = texts.mapInArrow(_counted_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return kept_nodes(materialize(counted, "grams"))


def kept_nodes(counted: DataFrame) -> DataFrame:
    """The kept nodes ``(depth, context, bits, one, own)``: probability of a one, and weight of the own estimate."""
    level = _decisions(counted).withColumn("below", F.lit(None).cast("double"))
    kept = None
    for depth in range(DEPTH, -1, -1):
        total = F.col("zeros") + F.col("ones")
        estimate = log_estimate(F.col("zeros"), F.col("ones"))
        level = level.withColumn("estimate", estimate)
        own = F.when(F.col("below").isNull(), F.lit(1.0)).otherwise(
            1 / (1 + F.exp(F.least(F.col("below") - F.col("estimate"), F.lit(700.0))))
        )
        level = level.withColumn("own", own)
        weighted = F.when(F.col("below").isNull() | (total < LEAST), F.col("estimate")).otherwise(
            F.when(F.col("below") > F.col("estimate"), F.col("below") + F.log1p(F.exp(F.col("estimate") - F.col("below"))))
            .otherwise(F.col("estimate") + F.log1p(F.exp(F.col("below") - F.col("estimate"))))
            - math.log(2)
        )
        level = materialize(level.withColumn("weighted", weighted), f"depth-{depth}")
        found = level.filter(total >= LEAST).select(
            F.lit(depth).alias("depth"), "context", "bits", ((F.col("ones") + 0.5) / (total + 1)).alias("one"), "own"
        )
        kept = found if kept is None else kept.unionByName(found)
        if depth:
            shorter = F.col("context").bitwiseAND((1 << (8 * (depth - 1))) - 1)
            level = level.groupBy(shorter.alias("context"), "bits").agg(
                F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")
            )
    return kept


class Tree:
    """The kept nodes as arrays; every node knows the next node of either bit in its context."""

    def __init__(self, depth: np.ndarray, context: np.ndarray, bits: np.ndarray, one: np.ndarray, own: np.ndarray) -> None:
        order = np.lexsort((bits, context, depth))
        depth, context, bits = depth[order], context[order], bits[order]
        self.one = np.append(one[order], 0.5)
        self.own = np.append(own[order], 0.0)
        nodes = len(order)
        self.none = nodes
        self.next = np.full((2, nodes + 1), nodes, np.int64)
        first = np.flatnonzero(bits == 1)
        self.roots = {
            d: (context[first[depth[first] == d]], first[depth[first] == d]) for d in range(DEPTH + 1)
        }
        group = np.cumsum(np.concatenate(([0], (np.diff(depth) != 0) | (np.diff(context) != 0)))) if nodes else depth
        key = group * 256 + bits
        for bit in range(2):
            wanted = group * 256 + (2 * bits + bit)
            at = np.searchsorted(key, wanted)
            held = (at < nodes) & (2 * bits + bit < 256)
            held[held] = key[at[held]] == wanted[held]
            self.next[bit, :nodes][held] = at[held]

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte after its context."""
        at = np.full((DEPTH + 1, len(code)), self.none)
        for d in range(DEPTH + 1):
            contexts, first = self.roots[d]
            asked = (code >> 8) & ((1 << (8 * d)) - 1)
            if len(contexts):
                i = np.minimum(np.searchsorted(contexts, asked), len(contexts) - 1)
                at[d] = np.where(contexts[i] == asked, first[i], self.none)
        total = np.zeros(len(code))
        for k in range(7, -1, -1):
            bit = (code >> k) & 1
            one = np.full(len(code), 0.5)
            seen = np.zeros(len(code), bool)
            for d in range(DEPTH, -1, -1):
                node = at[d]
                held = node != self.none
                own = np.where(seen, self.own[node], 1.0)
                one = np.where(held, own * self.one[node] + (1 - own) * one, one)
                seen |= held
                at[d] = self.next[bit, node]
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


class Store:
    """Byte probabilities already worked out, by a slot of the gram's number."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.code = np.full(STORED_GRAMS, -1, np.int64)
        self.value = np.zeros(STORED_GRAMS)

    def log10(self, code: np.ndarray) -> np.ndarray:
        slot = ((code * 0x9E3779B97F4A7C1) >> 40) & (STORED_GRAMS - 1)
        result = self.value[slot]
        missed = np.flatnonzero(self.code[slot] != code)
        if len(missed):
            new, back = np.unique(code[missed], return_inverse=True)
            values = self.tree.log10(new)
            result[missed] = values[back]
            slots = ((new * 0x9E3779B97F4A7C1) >> 40) & (STORED_GRAMS - 1)
            self.code[slots], self.value[slots] = new, values
            clash = self.code[slots] != new  # the last of several grams of a slot stays
            self.value[slots[~clash]] = values[~clash]
        return result


class Known:
    """Looks up the probabilities of a block's grams, by a slot of the gram's number or by search."""

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(code)
        self.code, self.value = code[order], value[order]
        self.shift = np.int64(63 - min(22, max(8, (2 * len(code)).bit_length())))
        self.slot = np.zeros(1 << int(63 - self.shift), np.int32)
        self.slot[self._slots(self.code)] = np.arange(len(code))

    def _slots(self, code: np.ndarray) -> np.ndarray:
        return ((code * 0x1E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF) >> self.shift

    def log10(self, code: np.ndarray) -> np.ndarray:
        at = self.slot[self._slots(code)]
        missed = np.flatnonzero(self.code[at] != code)
        at[missed] = np.searchsorted(self.code, code[missed])
        return self.value[at]


def score_texts(store: Store | Known, texts: list[bytes]) -> np.ndarray:
    """Log10 probability of each text and its end, over pieces of about ``SCORED_BYTES``."""
    sums = np.zeros(len(texts))
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= SCORED_BYTES or i == len(texts) - 1:
            some = texts[first : i + 1]
            begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some])[:-1]))
            sums[first : i + 1] = np.add.reduceat(store.log10(grams(some)), begin)
            first, size = i + 1, 0
    return sums


NODE = ("depth", "context", "bits", "one", "own")


def collect_tree(nodes: DataFrame) -> Tree:
    """The nodes of a small tree, as arrays."""
    table = nodes.toArrow()
    return Tree(*(table.column(c).to_numpy() for c in NODE))


def gram_values(grams: DataFrame, nodes: DataFrame, n_grams: int) -> DataFrame:
    """``(gram, log10)`` of distinct grams: the probability of the gram's byte after its context."""
    table = nodes.filter("depth < 2").toArrow()
    top = nodes.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in NODE])

    def group(context: Column, name: str) -> Column:
        return F.pmod(F.hash(context.bitwiseAND(0xFFFF)), F.lit(1 + n_grams // GROUP_GRAMS)).alias(name)

    def evaluate(asked: pa.Table, held: pa.Table) -> pa.Table:
        code = asked.column("gram").to_numpy()
        tree = Tree(*(np.concatenate((x, held.column(c).to_numpy())) for x, c in zip(top.value, NODE)))
        values = [tree.log10(code[lo : lo + TREE_GRAMS]) for lo in range(0, len(code), TREE_GRAMS)]
        return pa.table({"gram": code, "log10": np.concatenate(values) if values else np.zeros(0)})

    asked = grams.select("gram", group(F.shiftright("gram", 8), "group")).groupBy("group")
    held = nodes.filter("depth >= 2").select(*NODE, group(F.col("context"), "held_by")).groupBy("held_by")
    return asked.cogroup(held).applyInArrow(evaluate, "gram long, log10 double")


def text_scores(texts: DataFrame, values: DataFrame) -> DataFrame:
    """``(row, score, n_bytes)`` of ``(block, row, text)``; ``values(block, gram, log10)`` has every gram of a block."""

    def evaluate(rows: pa.Table, held: pa.Table) -> pa.Table:
        known = Known(held.column("gram").to_numpy(), held.column("log10").to_numpy())
        some = rows.column("text").to_pylist()
        sizes = np.array([len(t) + 1 for t in some], np.int64)
        return pa.table({"row": rows.column("row"), "score": score_texts(known, some), "n_bytes": sizes})

    asked = values.select(F.col("block").alias("asking"), "gram", "log10").groupBy("asking")
    return texts.groupBy("block").cogroup(asked).applyInArrow(evaluate, "row long, score double, n_bytes long")


BASE = (
    "doc_id {id}, row long, n_tokens long, n_common long, common_score double,"
    " others array<struct<token:binary,n:long>>"
)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base measures, ``score`` (log10) and ``bits_per_byte``; learns from texts not held out."""
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    training = read.filter(~held_out())
    counts, totals = materialize_with(
        training.select("text").mapInArrow(_counted_words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")),
        "words",
        words=F.coalesce(F.sum("n"), F.lit(0)),
        distinct=F.count(F.lit(1)),
    )
    ends = training.count()
    n_all, n_distinct = totals["words"] + ends, totals["distinct"] + (ends > 0)
    id_type = docs.schema[doc_id].dataType.simpleString()
    cut = materialize(
        read.withColumn("held", held_out()).mapInArrow(_cut, BLOCKS.format(id=id_type)), "blocks", compression="zstd"
    )
    rows, asked = cut.filter("gram IS NULL"), cut.filter("gram IS NOT NULL").select("block", "gram", "n")
    counted, distinct = materialize_with(
        asked.groupBy("gram").agg(F.sum("n").alias("n")), "grams", grams=F.count(F.lit(1))
    )
    values = materialize(gram_values(counted, kept_nodes(counted.filter("n > 0")), distinct["grams"]), "values")
    scores = materialize(
        text_scores(rows.select("block", "row", "text"), asked.select("block", "gram").join(values, "gram")), "scores"
    )
    frequent = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    size = n_all + 0.1 * (n_distinct + 1)
    floor = math.log10(0.1 / size)
    shared = spark.sparkContext.broadcast(
        (
            dict(zip(frequent.column("token").to_pylist(), np.log10((frequent.column("n").to_numpy() + 0.1) / size).tolist())),
            math.log10((ends + 0.1) / size),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, end = shared.value
        for rows, texts in blocks(batches, 2, SCORED_BYTES):
            split = [t.translate(LOWER).split() for t in texts]
            known = [[common[w] for w in ws if w in common] for ws in split]
            others = [Counter(w for w in ws if w not in common) for ws in split]
            flat = pa.StructArray.from_arrays(
                [
                    pa.array([w for c in others for w in c], pa.binary()),
                    pa.array([n for c in others for n in c.values()], pa.int64()),
                ],
                names=["token", "n"],
            )
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in others]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array([len(ws) + 1 for ws in split], pa.int64()),
                    pa.array([len(k) + (ends > 0) for k in known], pa.int64()),
                    pa.array([math.fsum(k) + end for k in known], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(bounds), flat),
                ],
                names=["doc_id", "row", "n_tokens", "n_common", "common_score", "others"],
            )

    base = materialize(rows.select("doc_id", "row", "text").mapInArrow(run, BASE.format(id=id_type)), "base")
    rest = base.select("row", F.explode("others").alias("o")).select("row", "o.token", F.col("o.n").alias("times"))
    known = F.col("n").isNotNull()
    log = F.when(known, F.log10((F.col("n") + 0.1) / size)).otherwise(floor)
    rare = (
        rest.join(counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.when(known, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(log * F.col("times")).alias("rare_score"))
    )
    return base.drop("others").join(scores, "row").join(rare, "row", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
