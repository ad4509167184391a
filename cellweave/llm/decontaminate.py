"""Benchmark decontamination by a positional inverted index of the corpus.

The index is partitioned by document: each row holds a block of documents and, for
every word of the block, the sorted list of its positions. All positions of a block
share one axis on which documents are ``GAP`` apart, so no phrase crosses from one
document into the next. A very frequent word is spread over all blocks, and no row
grows with the corpus.

A search takes windows of consecutive test words. Within a block it drops every
window with a word the block lacks, then intersects the position lists, each shifted
back by the word's place in the window, from the shortest list on. What is left are
exact phrases. The proximity search lets every word stray by ``slop`` places from
where the window has it.

Defined cases: null and empty texts have no words, are kept and never contaminated;
test items without words have no window; an item with fewer words than a window is
one window; repeated rows are judged each by itself; null item ids still hit words
but are not listed; an empty corpus or test set gives no hits. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import WORD, blocks
from cellweave.session import arrow_batches, materialize

WINDOW = 13
GAP = 16

#: Bytes of the batches in which texts and rows of the index travel to Python, one row at least: a task
#: holds a few of them at once, and the buffers of many tasks stay with an executor until it collects garbage.
BATCH_BYTES = 4 << 20

#: Bytes of test texts searched at once; a larger test set is searched in several passes.
SLICE_BYTES = 4 << 20

#: Windows looked up at once.
LOOKED_UP = 1 << 16

INDEX = "doc_ids array<{id}>, n_words array<int>, starts array<int>, terms array<string>, offsets array<int>, positions array<int>"
HITS = "block long, at int, items array<string>, near array<string>, spans array<struct<s:int,e:int>>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all other than ASCII characters."""
    return text.translate(WORD).split()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in blocks(batches):
        split = [words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + GAP)[:-1]))
        ids: dict[bytes, int] = {}
        term = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int32, int(sizes.sum()))
        place = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(term))
        order = np.argsort(term, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(ids)))))
        terms = pa.array(list(ids), pa.binary()).cast(pa.string())

        def cell(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        yield pa.RecordBatch.from_arrays(
            [
                cell(rows.column(0)),
                *(cell(pa.array(x.astype(np.int32))) for x in (sizes, starts)),
                cell(terms),
                *(cell(pa.array(x.astype(np.int32))) for x in (bounds, place[order])),
            ],
            names=["doc_ids", "n_words", "starts", "terms", "offsets", "positions"],
        )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings of all words of all documents; one row per block, with a ``block`` number."""
    schema = INDEX.format(id=docs.schema[doc_id].dataType.simpleString())
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = read.mapInArrow(_indexed, schema).withColumn("block", F.monotonically_increasing_id())
    # readers hold a row group at once; no value comes often in one, so dictionaries would only cost time
    small = {"parquet.block.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return materialize(index, "postings", compression="zstd", **small)


@dataclass(frozen=True)
class Windows:
    """Distinct windows of test texts as arrays, for a slice has a window for almost every word."""

    vocabulary: list[bytes]
    grid: np.ndarray  # windows x words, places in the vocabulary; a shorter window repeats its first word
    length: np.ndarray  # words of a window
    first: np.ndarray  # per window, and one past the last, the place of its texts in ``owner``
    owner: np.ndarray

    def __len__(self) -> int:
        return len(self.grid)

    def words(self, w: int) -> np.ndarray:
        return self.grid[w, : self.length[w]]

    def owners(self, w: int) -> np.ndarray:
        """The texts a window stands in, by rising number."""
        return self.owner[self.first[w] : self.first[w + 1]]


def windows(texts: list[bytes], size: int = WINDOW) -> Windows:
    """Test vocabulary, the distinct windows as places in it, and the texts each window stands in."""
    vocabulary: dict[bytes, int] = {}
    rows = [np.empty((0, size + 2), np.int32)]
    for i, text in enumerate(texts):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], np.int32)
        if not len(ids):
            continue
        if len(ids) < size:
            found = np.concatenate((ids, np.full(size - len(ids), ids[0], np.int32)))[None, :]
        else:
            found = np.unique(np.lib.stride_tricks.sliding_window_view(ids, size), axis=0)
        at = np.full((len(found), 1), i, np.int32)
        rows.append(np.hstack([found, np.full_like(at, min(len(ids), size)), at]))
    every = np.concatenate(rows)
    every = every[np.lexsort(every.T[::-1])]  # equal windows together, their texts rising
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :-1] != every[:-1, :-1]).any(axis=1)
    first = np.append(np.flatnonzero(new), len(every))
    return Windows(list(vocabulary), every[new, :size], every[new, size], first, every[:, -1].copy())


def phrase_starts(lists: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """Places where the words of a window stand: the k-th word at start + k, give or take ``slop``."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]].astype(np.int64) - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        near = np.searchsorted(lists[k], starts + k - slop)
        held = near < len(lists[k])
        held[held] = lists[k][near[held]] <= starts[held] + k + slop
        starts = starts[held]
    return starts


def _searcher(test, slop: int):
    """Searches each index row for the windows of the broadcast test slice."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = test.value
        if not any(map(words, texts)):
            return
        found = windows(texts)
        lookup = pa.array(found.vocabulary, pa.binary()).cast(pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                out = _search_block(batch, row, lookup, found, names, slop)
                if out is not None:
                    yield out

    return search


def _values(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))[row].values


def _held(at: np.ndarray, found: Windows) -> Iterator[int]:
    """Windows all of whose words have a place."""
    for lo in range(0, len(found), LOOKED_UP):
        left = np.arange(lo, min(lo + LOOKED_UP, len(found)))
        for words_at in found.grid[lo : lo + LOOKED_UP].T:
            left = left[at[words_at[left - lo]] >= 0]
        yield from left


def _search_block(batch: pa.RecordBatch, row: int, lookup: pa.Array, found: Windows, names: list, slop: int) -> pa.RecordBatch | None:
    terms = _values(batch, "terms", row)
    if not len(terms) or not len(found):
        return None
    at = pc.index_in(lookup, value_set=terms).to_numpy(zero_copy_only=False)
    at = np.where(np.isnan(at), -1, at).astype(np.int64)
    offsets = _values(batch, "offsets", row).to_numpy()
    positions = _values(batch, "positions", row).to_numpy()
    starts = _values(batch, "starts", row).to_numpy()
    sizes = _values(batch, "n_words", row).to_numpy()
    cover = np.zeros(int(starts[-1]) + int(sizes[-1]) + GAP + 1, np.int32)
    exact: set[tuple[int, str]] = set()
    near: set[tuple[int, str]] = set()
    for w in _held(at, found):
        lists = [positions[offsets[t] : offsets[t + 1]] for t in at[found.words(w)]]
        places = phrase_starts(lists)
        items = [names[i] for i in found.owners(w)]
        if len(places):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + len(lists), -1)
            inside = np.unique(np.searchsorted(starts, places, side="right") - 1)
            exact.update((int(d), x) for d in inside for x in items)
        if slop:
            places = phrase_starts(lists, slop)
            inside = np.unique(np.searchsorted(starts, np.maximum(places, 0), side="right") - 1)
            near.update((int(d), x) for d in inside for x in items)
    if not exact and not near:
        return None
    edge = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0))
    begin, end = edge[::2], edge[1::2]
    owner = np.searchsorted(starts, begin, side="right") - 1
    docs = sorted({d for d, _ in exact} | {d for d, _ in near})
    by_exact: dict[int, list[str]] = {}
    by_near: dict[int, list[str]] = {}
    for group, pairs in ((by_exact, exact), (by_near, near)):
        for d, x in pairs:
            group.setdefault(d, [])
            if x is not None:
                group[d].append(x)
    spans = [[{"s": int(begin[i]), "e": int(end[i])} for i in np.flatnonzero(owner == d)] for d in docs]
    block = batch.column(batch.schema.get_field_index("block"))[row].as_py()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(docs), pa.int64()),
            pa.array(docs, pa.int32()),
            pa.array([by_exact.get(d, []) for d in docs], pa.list_(pa.string())),
            pa.array([by_near.get(d, []) for d in docs], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
        ],
        names=["block", "at", "items", "near", "spans"],
    )


def search(index: DataFrame, tests: DataFrame, item_id: str = "item_id", text: str = "text", slop: int = 2) -> DataFrame:
    """Hits of all windows of all test items: one row per document of the index that has any.

    The test set is broadcast in slices of about ``SLICE_BYTES``; every slice is searched
    for in the whole index. ``items`` have a phrase of the document, ``near`` a phrase or
    a window within ``slop`` (below the gap between documents).
    """
    spark = index.sparkSession
    read = tests.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // SLICE_BYTES
    found = None
    for part in range(parts):
        rows = read.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        test = spark.sparkContext.broadcast(([r.item for r in rows], [r.text.encode() for r in rows]))
        hits = index.drop("doc_ids").mapInArrow(_searcher(test, slop), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def contamination(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", slop: int = 2) -> DataFrame:
    """One row per document: words, words hit, items with a phrase and near it, and the verdict."""
    index = build_index(docs, doc_id, text)
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        hits = materialize(search(index, tests, slop=slop), "hits")
    merged = (
        hits.groupBy("block", "at")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.size(F.array_distinct(F.flatten(F.collect_list("near")))).cast("long").alias("n_near"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        .withColumn(
            "n_hit",
            F.expr(
                "aggregate(spans, struct(0L AS n, -1 AS past),"
                " (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.past)) AS n, greatest(a.past, x.e) AS past),"
                " a -> a.n)"
            ),
        )
        .drop("spans")
    )
    every = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select(
        "block", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(merged, ["block", "at"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
