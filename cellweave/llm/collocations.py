"""Phrases that are more than their parts, mined from a weighted de Bruijn graph.

Texts are lower-cased (A-Z) and split at punctuation into pieces, pieces into words. In
the graph of a language three words in a row are a node and four are an edge from the
node of the first three to that of the last three, weighted by how often they occur.
Only edges are counted over the texts. What else is needed are the ends of pieces: an
occurrence of a node is followed by a word (an edge leaves it) or ends a piece, so its
count is the weight of its outgoing edges plus its ends. The same holds for two words
and for one.

Counts are summed while streaming over rows that are sorted by first words, so a group
never has to fit in memory, and rows that stay below the least count are dropped as soon
as they are whole. Blocks of text are counted before the shuffle. Rows go to partitions
by their first word; words that are frequent in a sample of texts (``HEAVY_SHARE``) are
spread by their second word, frequent pairs by their third, and added up again, which
changes no result.

Among nodes and edges of at least ``least`` occurrences, runs without branches are
compacted to paths. A path is a repeated passage with its node and edge counts in order;
a phrase of three words is compared with the longer ones of its paths. Pairs of words are
compared with the phrases of three and four words that hold them.

Defined cases: a null text has no words, a null language is ``und``; repeated rows are
counted as often as they occur; ids are not read; ties in score and count go by the
phrase's bytes; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellweave.llm.common import texts_of
from cellweave.session import materialize, materialize_with

#: Least count of a phrase, and the share of it in a longer phrase that makes it a part of that.
LEAST = 30
INSIDE_PERCENT = 80
TOP = 2000

#: Fixed value: scores are this many times the share of the phrase in the sum of its parts, floored.
SCALE = 2_000_000

#: Text that is counted at once in a task.
BLOCK_BYTES = 12 << 20

#: First words with more than this share of a sample's edges are spread over the partitions by the second, first
#: two words by the third.
HEAVY_SHARE = 0.0005
SAMPLE_TEXTS, SAMPLE_LETTERS = 2000, 2000

#: Text whose grams go to one partition, so that partitions grow in number and not in size.
PART_BYTES = 8 << 20

#: Byte that no UTF-8 text holds; stands for the end of a piece.
END = b"\xff"
PIECES = bytes(
    0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
GRAMS_SQL = "gram string"
FLOWS_SQL = "lang string, size int, phrase string, n long"
FLOWS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2^31 and the number of each row's pair."""
    codes, which = np.unique(a.astype(np.int64) << 31 | b, return_inverse=True)
    return codes >> 31, codes & 0x7FFFFFFF, which


def _joined(lang: str, *words: pa.Array) -> pa.Array:
    """``lang`` without tabs, a tab and the words; words hold no tabs."""
    head = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")
    return pc.binary_join_element_wise(pa.scalar(escaped(lang)), head, "\t")


def escaped(lang: str) -> str:
    """Without tabs and spaces."""
    return lang.replace("\\", "\\\\").replace("\t", "\\t").replace(" ", "\\s")


def unescaped(lang: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "s": " "}.get(m[1], m[1]), lang)


def block_grams(lang: str, texts: list[bytes]) -> pa.Array:
    """Counted edges and piece ends of a block of texts of one language, as strings.

    Fields end with tabs: the language, the first two words, the next two. The count follows
    if it is not 1. Words beyond the end of a piece are empty, and the last word of a piece
    stands by itself too. As every field has its end mark, rows with the same first words are
    neighbours in sorted order.
    """
    split = END.join(texts).translate(PIECES).replace(END, b" \xff ").split()
    encoded = pa.array([END, *split, END], pa.binary()).dictionary_encode()
    del split
    words = encoded.dictionary.to_pylist()
    words[0] = b""  # the end mark is the first word
    words = pa.array(words, pa.binary()).view(pa.string())
    x = encoded.indices.to_numpy()
    is_word = x != 0

    at = np.flatnonzero(is_word[:-1] & is_word[1:])  # two words start here
    w1, w2, pairs = _unique_pairs(x[at], x[at + 1])
    after = np.append(x, [0, 0])
    third, fourth = after[at + 2], after[at + 3]
    fourth = np.where(third == 0, 0, fourth)
    w3, w4, tails = _unique_pairs(third, fourth)
    a, b, which = _unique_pairs(pairs, tails)
    n = np.bincount(which, minlength=len(a))
    heads = _joined(lang, words.take(pa.array(w1)), words.take(pa.array(w2)))
    tail = pc.binary_join_element_wise(words.take(pa.array(w3)), words.take(pa.array(w4)), " ")
    edges = pc.binary_join_element_wise(heads.take(pa.array(a)), tail.take(pa.array(b)), _number(n), "\t")
    # last words of pieces
    ends, n = np.unique(x[np.flatnonzero(is_word[:-1] & ~is_word[1:])], return_counts=True)
    last = pc.binary_join_element_wise(_joined(lang, words.take(pa.array(ends))), pa.scalar(" "), _number(n), "\t")
    return pa.concat_arrays([edges, last])


def _number(n: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(n > 1), pa.array(n).cast(pa.string()), "")


def _grams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size = 0

    def counted():
        for lang in sorted(held):
            found = block_grams(lang, held[lang])
            for lo in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([found.slice(lo, 100_000)], ["gram"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if not text:
                continue
            if size and size + len(text) > most:
                yield from counted()
                size = 0
            held.setdefault(lang, []).append(text)
            size += len(text)
    yield from counted()


def head_of(gram: Column) -> Column:
    """The language and the first words."""
    return F.substring_index(gram, "\t", 2)


def word_of(head: Column) -> Column:
    """The language and the first word."""
    return F.substring_index(head, " ", 1)


def shuffle_plan(texts: DataFrame) -> tuple[set[str], set[str], int]:
    """How grams are dealt out; it changes no result.

    First words, and first two words, that are frequent in a bounded sample of texts, with their language, and the
    bytes of all texts.
    """
    whole = Observation()
    some = texts.observe(whole, F.sum(F.octet_length("text")).alias("bytes")).select("lang", F.left("text", F.lit(SAMPLE_LETTERS)).alias("text"), F.xxhash64("text").alias("h")).orderBy("h", "lang").limit(SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grams(batches, BLOCK_BYTES)

    heads = some.select("lang", "text").mapInArrow(run, GRAMS_SQL).select(head_of(F.col("gram")).alias("head"))
    rows, seen = materialize_with(heads, "sample-heads", n=F.count(F.lit(1)))
    least = max(20, HEAVY_SHARE * seen["n"])
    often = lambda key: {r[0] for r in rows.groupBy(key.alias("key")).count().filter(F.col("count") > least).collect()}
    return often(word_of(F.col("head"))), often(F.col("head")), whole.get["bytes"] or 0


def _shared_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it, from its start; 0 for the first."""
    shared = np.zeros(len(start), np.int64)
    room = np.zeros(len(start), np.int64)
    room[1:] = np.minimum(size[1:], size[:-1])
    going = np.flatnonzero(room > 0)
    at = 0
    while len(going):
        going = going[data[start[going] + at] == data[start[going - 1] + at]]
        at += 1
        shared[going] = at
        going = going[room[going] > at]
    return shared


class _Level:
    """Sums of runs of grams with a common field in a sorted stream; the last run stays open."""

    def __init__(self, size: int, least: int):
        self.size, self.least = size, least
        self.key, self.total = None, 0

    def add(self, new: np.ndarray, n: np.ndarray, keys) -> list[tuple[bytes, int]]:
        """Closed runs of at least the least sum; ``keys(row)`` is the key of a run that starts there, None if it has none."""
        starts = np.flatnonzero(new)
        if not len(starts):
            self.total += int(n.sum())
            return []
        closed = [(self.key, self.total + int(n[: starts[0]].sum()))]
        sums = np.add.reduceat(n, starts)
        kept = np.flatnonzero(sums[:-1] >= self.least)
        closed += [(keys(starts[i]), int(sums[i])) for i in kept]
        self.key, self.total = keys(starts[-1]), int(sums[-1])
        return [c for c in closed if c[0] is not None and c[1] >= self.least]

    def close(self) -> list[tuple[bytes, int]]:
        return [(self.key, self.total)] if self.key is not None and self.total >= self.least else []


def _flows(batches: Iterator[pa.RecordBatch], least: int, heavy: set[str]) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of one to four words from sorted edges and ends.

    Phrases of three and four words are whole here and dropped below ``least``; so are
    pairs unless their head is spread over partitions. First words of pairs are partial sums.
    Neighbours in sorted order have a field in common if they share its bytes and end mark.
    """
    four, three, two, spread, one = _Level(4, least), _Level(3, least), _Level(2, least), _Level(2, 1), _Level(1, 1)
    spread_heads = {h.encode() for h in heavy}
    last = b""

    def rows(found: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        langs: dict[bytes, str] = {}
        split = [key.split(b"\t", 1) for _, key, _ in found]
        for lang, _ in split:
            if lang not in langs:
                langs[lang] = unescaped(lang.decode())
        phrases = pa.array([words for _, words in split], pa.binary()).view(pa.string())
        sizes, sums = pa.array([f[0] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([langs[lang] for lang, _ in split], pa.string()), sizes, phrases, sums], schema=FLOWS)

    for batch in batches:
        if not batch.num_rows:
            continue
        # the last gram of the batch before comes first, so that runs go on
        grams = pa.concat_arrays([pa.array([last or b"\t\t\t"], pa.binary()), batch.column(0).cast(pa.binary())])
        last = grams[-1].as_py()
        data = np.frombuffer(grams.buffers()[2], np.uint8)
        offsets = np.frombuffer(grams.buffers()[1], np.int32)[: len(grams) + 1].astype(np.int64)
        start, size = offsets[:-1], np.diff(offsets)
        body = data[offsets[0] : offsets[-1]]
        tabs = (np.flatnonzero(body == 9) + offsets[0]).reshape(-1, 3)  # three end marks in each
        space = np.flatnonzero(body == 32) + offsets[0]
        # first space after the language, if it is before the end of the head; and the one in the tail
        after = lambda at: np.append(space, len(data))[np.searchsorted(space, at)]  # noqa: B023,E731
        first_end = np.minimum(after(tabs[:, 0]), tabs[:, 1])
        third_end = after(tabs[:, 1])
        shared = _shared_prefixes(data, start, size)[1:]
        start, end, size = start[1:], offsets[2:], size[1:]
        tabs, first_end, third_end = tabs[1:], first_end[1:], third_end[1:]
        n = np.zeros(len(start), np.int64)
        digits = end - tabs[:, 2] - 1
        for k in range(int(digits.max(initial=0))):
            here = np.flatnonzero(digits > k)
            n[here] = 10 * n[here] + data[tabs[here, 2] + 1 + k] - 48
        n[digits == 0] = 1

        def key(stop: np.ndarray, there: np.ndarray):
            return lambda i: bytes(data[start[i] : stop[i]]) if there[i] else None  # noqa: B023

        paired = first_end < tabs[:, 1]
        has3, has4 = third_end > tabs[:, 1] + 1, tabs[:, 2] > third_end + 1
        found = [(1, *x) for x in one.add(shared <= first_end - start, n, key(first_end, np.ones(len(n), bool)))]
        new2 = shared <= tabs[:, 1] - start
        plain, marked = key(tabs[:, 1], paired), key(tabs[:, 1], paired)
        if spread_heads:
            plain = lambda i, of=plain: None if (k := of(i)) in spread_heads else k
            marked = lambda i, of=marked: k if (k := of(i)) in spread_heads else None
            found += [(2, *x) for x in spread.add(new2, n, marked)]
        found += [(2, *x) for x in two.add(new2, n, plain)]
        found += [(3, _one_space(k), v) for k, v in three.add(shared <= third_end - start, n, key(third_end, paired & has3))]
        found += [(4, _one_space(k), v) for k, v in four.add(shared <= tabs[:, 2] - start, n, key(tabs[:, 2], has4))]
        if found:
            yield rows(found)
    found = [(x.size, _one_space(k) if x.size > 2 else k, v) for x in (four, three, two, spread, one) for k, v in x.close()]
    if found:
        yield rows(found)


def _one_space(key: bytes) -> bytes:
    """The phrase of a key: the tab between the second and the third word becomes a space."""
    lang, head, tail = key.split(b"\t")
    return lang + b"\t" + head + b" " + tail


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, block: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, size, phrase, n)``: all words, and the phrases of two to four words found ``least`` times or more."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    words, heavy, size = shuffle_plan(texts)
    parts = max(1, size // PART_BYTES)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grams(batches, block)

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flows(batches, least, heavy)

    gram, head = F.col("gram"), head_of(F.col("gram"))
    node = F.regexp_replace(gram, r"[^ \t]*\t[^\t]*$", "")  # up to the third word; for spread heads only
    # by first word, frequent ones by the first two, frequent pairs by the first three
    target = F.when(head.isin(sorted(heavy)), node).otherwise(head) if heavy else head
    target = F.when(word_of(head).isin(sorted(words)), target).otherwise(word_of(head)) if words else word_of(head)
    edges = texts.mapInArrow(grams, GRAMS_SQL).repartition(parts, target).sortWithinPartitions("gram")
    flow = materialize(edges.mapInArrow(flows, FLOWS_SQL), "flows", "zstd")
    # pairs of spread heads and words are partial sums of partitions; the others are one row each
    added = flow.filter("size <= 2").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    whole = flow.filter("size > 2").select("lang", "size", "phrase", "n")
    return materialize(added.filter((F.col("size") == 1) | (F.col("n") >= least)).unionByName(whole), "phrases", "zstd")


def words_between(phrase: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def paths(phrases: DataFrame) -> DataFrame:
    """``(lang, words, nodes, edges)``: runs of the frequent graph without branches.

    ``words`` are those of the passage, ``nodes`` the counts of its phrases of three words and ``edges`` of those of
    four, in order. An edge joins the next one if their common node has no other frequent edge in or out; heads are
    found by doubling the links, every round a written table. Edges of a ring without an entrance stay single.
    """
    nodes = phrases.filter("size = 3").select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    edges = phrases.filter("size = 4").select(
        "lang",
        F.col("phrase").alias("edge"),
        F.col("n").alias("weight"),
        words_between(F.col("phrase"), 1, 3).alias("begin"),
        words_between(F.col("phrase"), 2, 3).alias("end"),
    )
    edges = materialize(
        edges.join(nodes.select("lang", F.col("node").alias("begin"), F.col("flow").alias("begin_flow")), ["lang", "begin"])
        .join(nodes.select("lang", F.col("node").alias("end"), F.col("flow").alias("end_flow")), ["lang", "end"]),
        "frequent-edges",
    )
    leaving = edges.groupBy("lang", F.col("begin").alias("node")).agg(F.count("*").alias("outs"))
    coming = edges.groupBy("lang", F.col("end").alias("node")).agg(F.count("*").alias("ins"), F.min("edge").alias("before"))
    unary = coming.join(leaving, ["lang", "node"]).filter("ins = 1 AND outs = 1").select("lang", F.col("node").alias("begin"), "before")
    # every edge points at the edge before it, with the number of steps; a head points nowhere
    links = edges.join(unary, ["lang", "begin"], "left").select(
        "lang", "edge", F.when(F.col("before") != F.col("edge"), F.col("before")).alias("before")
    )
    state = links.select("lang", "edge", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("before").isNull().alias("done"))
    state, seen = materialize_with(state, "links", n=F.count_if(~F.col("done")))
    while seen["n"]:
        ahead = state.select("lang", F.col("edge").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"), F.col("done").alias("far_done"))
        moved = state.filter("NOT done").join(ahead, ["lang", "head"]).select(
            "lang", "edge", F.col("far").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("far_done").alias("done")
        )
        state, now = materialize_with(state.filter("done").unionByName(moved), "links", n=F.count_if(~F.col("done")))
        if now["n"] == seen["n"]:  # only rings are left
            state = state.select("lang", "edge", F.when(F.col("done"), F.col("head")).otherwise(F.col("edge")).alias("head"), F.when(F.col("done"), F.col("steps")).otherwise(0).alias("steps"), F.lit(True).alias("done"))
            break
        seen = now
    along = F.struct("steps", "edge", "weight", "begin_flow", "end_flow")
    runs = state.join(edges, ["lang", "edge"]).groupBy("lang", "head").agg(F.array_sort(F.collect_list(along)).alias("run"))
    last = F.transform("run", lambda x: F.split_part(x["edge"], F.lit(" "), F.lit(4)))
    return runs.select(
        "lang",
        F.concat(F.slice(F.split("head", " "), 1, 3), last).alias("words"),
        F.concat(F.transform(F.slice("run", 1, 1), lambda x: x["begin_flow"]), F.transform("run", lambda x: x["end_flow"])).alias("nodes"),
        F.transform("run", lambda x: x["weight"]).alias("edges"),
    )


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE_PERCENT, block: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: every frequent phrase of two to four words that no longer one explains.

    ``l`` and ``r`` are the counts of the parts at the lowest-scoring cut, ``n`` all words of the language.
    """
    phrases = phrase_counts(docs, text, lang, least, block)
    return scored(phrases, explained(phrases, inside))


def explained(phrases: DataFrame, inside: int = INSIDE_PERCENT) -> DataFrame:
    """``(lang, phrase)`` of phrases that a longer frequent phrase holds in ``inside`` percent of their occurrences."""
    found = paths(phrases)
    # along a path every edge holds the nodes before and after it
    held = found.select(
        "lang",
        F.explode(
            F.flatten(
                F.transform(
                    "edges",
                    lambda weight, i: F.array(
                        *(
                            F.struct(
                                F.array_join(F.slice("words", i + 1 + k, 3), " ").alias("phrase"),
                                F.get("nodes", i + k).alias("a"),
                                weight.alias("longer"),
                            )
                            for k in (0, 1)
                        )
                    ),
                )
            )
        ).alias("x"),
    ).select("lang", "x.*")
    threes = held.filter(100 * F.col("longer") >= inside * F.col("a")).select("lang", "phrase")
    pairs = phrases.filter("size = 2").select("lang", "phrase", F.col("n").alias("a"))
    longer = phrases.filter("size > 2").select(
        "lang",
        F.col("n").alias("longer"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: words_between(F.col("phrase"), k, 2))).alias("phrase"),
    )
    best = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    twos = pairs.join(best, ["lang", "phrase"]).filter(100 * F.col("longer") >= inside * F.col("a")).select("lang", "phrase")
    return threes.union(twos).distinct()


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    kept = phrases.filter("size >= 2").join(parts, ["lang", "phrase"], "left_anti")
    cuts = kept.select(
        "lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.withColumn("first", words_between(F.col("phrase"), F.lit(1), F.col("k"))).withColumn(
        "rest", words_between(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))
    )
    # parts of a frequent phrase are as frequent, so rare words need not be read
    known = phrases.filter("size < 4").select("lang", "phrase", "n")
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    wide = "decimal(38,0)"
    score = F.expr(f"(cast({SCALE} as {wide}) * a) div (cast(l as {wide}) + r)")
    best = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    )
    totals = phrases.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language with their rank; a sorted pre-selection by buckets keeps groups small."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    some = some.filter(F.col("rank") <= top).drop("bucket")
    full = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return full.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

