"""A written index of vectors: balls around pivots, cut into pages by distance from the pivot.

The *node table* has one row per page: its ball, the least and greatest distance of its
vectors from the ball's pivot, and their number. The *leaf table* has one packed row per
page with ids and vectors. By the triangle inequality a query at distance ``d`` from the
pivot is at least ``d - greatest`` and at least ``least - d`` away from all of a page, so
pages are visited in the order of that bound, and a query is finished, exactly, when the
next bound is beyond its k-th neighbour. Stopping after a number of pages instead gives
an approximate answer.

Pages come from one range sort by ball, distance and id: a ball that holds a third of all
vectors, or equal vectors, spreads over as many pages (and partitions) as it needs, and no
page is larger than asked for. On their first visit queries travel to pages packed by Arrow
batch. Queries that are not done by then are held in slices of bounded size while the pages
stream past them, so a vector is shuffled once per slice and not once per visit. The pivots
and the node table are broadcast; their numbers are bounded by ``MAX_PIVOTS`` bytes and
``MAX_PAGES``. Tables that grow are joined by sorting, never broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.vectors import list_matrix, matrix_list
from cellweave.session import materialize, materialize_with

PAGE_ROWS = 2048
MAX_PAGES = 65_536
MAX_PIVOTS = 16 * 2**20  # bytes of the broadcast pivots

#: Pages of a query's first visit; every further visit takes twice as many, up to the last figure.
FIRST_PAGES, MOST_PAGES = 2, 1024

#: Distances between queries and pages held at once in a task.
PLANNED = 4_000_000
ASSIGNED_ROWS = 1024

#: Bytes of queries and their neighbours that a task holds while pages stream past, tasks of a search at
#: least (if there are so many comparisons), shares of the pages at most (each share gives every query its own
#: neighbours), comparisons worth a task, rows of pages compared at once, pairs measured at once.
HELD_BYTES = 64 * 2**20
TASKS = 48
SHARES = 4
TASK_PAIRS = 4_000_000
CHUNK_ROWS = 2048
MEASURED = 50_000

#: Norm above which products are taken in double precision.
SINGLE = 1e30

DECIMALS = 10  # distances are compared at this precision, ties go to the smaller id
CANCELS = 1e-6  # share of the squared norms below which a squared distance is summed anew
SLACK = 1e-7  # of the bounds, relative to the distance from the pivot, far above rounding errors

LEAVES = "page long, ball int, low double, high double, n int, ids array<long>, vecs array<double>"
STATE = "cell_idx long, vec array<double>, nn array<long>, dist array<double>, seen array<int>"


def prepared(matrix: np.ndarray, metric: str) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=float)
    if metric == "cosine":
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    if metric == "euclidean":
        return matrix
    raise ValueError(f"unknown metric {metric}")


def distances(queries: np.ndarray, sample: np.ndarray, metric: str) -> np.ndarray:
    inner = queries @ sample.T
    if metric == "cosine":
        return np.round(1.0 - inner, DECIMALS) + 0.0
    return np.round(_euclidean(queries, sample, inner), DECIMALS)


def _euclidean(queries: np.ndarray, sample: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
    inner = queries @ sample.T if inner is None else inner
    norms = (queries**2).sum(1)[:, None] + (sample**2).sum(1)[None, :]
    squared = norms - 2 * inner
    # where nearly all digits cancel, the differences are summed instead
    i, j = np.nonzero(squared < CANCELS * norms)
    for lo in range(0, len(i), 100_000):
        a, b = i[lo:lo + 100_000], j[lo:lo + 100_000]
        squared[a, b] = ((queries[a] - sample[b]) ** 2).sum(1)
    return np.sqrt(np.maximum(squared, 0.0))


def smallest(dist: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k smallest per row, ordered, ties by position."""
    if dist.shape[1] <= k:
        return np.argsort(dist, axis=1, kind="stable")
    part = np.sort(np.argpartition(dist, k - 1, axis=1)[:, :k], axis=1)
    cut = np.take_along_axis(dist, part, axis=1).max(axis=1)
    tied = np.flatnonzero((dist <= cut[:, None]).sum(axis=1) > k)
    for row in tied:
        part[row] = np.sort(np.argsort(dist[row], kind="stable")[:k])
    order = np.argsort(np.take_along_axis(dist, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


@dataclass(frozen=True)
class Nodes:
    """What every task knows of the index: pivots, and per page its number, ball, ring and size."""

    pivots: np.ndarray
    page: np.ndarray
    ball: np.ndarray
    low: np.ndarray
    high: np.ndarray
    metric: str

    def bounds(self, queries: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Per query and page (all, or those ``at`` places) the least distance of the metric, and the distance from the pivot."""
        balls, ball = np.unique(self.ball[at], return_inverse=True)
        away = _euclidean(queries, self.pivots[balls])[:, ball]
        bound = np.maximum(np.maximum(away - self.high[at], self.low[at] - away) - SLACK * (1 + away), 0.0)
        if self.metric == "cosine":  # for unit vectors half the squared distance; zero vectors are never nearer than that
            bound = bound**2 / 2
        return bound, away

    def next_pages(self, queries: np.ndarray, seen: pa.ListArray, worst: np.ndarray, step: int) -> list[np.ndarray]:
        """The next pages of every query, by rising bound, among those that can hold a neighbour and were not visited.

        Equal bounds (mostly zeros of overlapping rings) go by the distance from the pivot.
        """
        bound, away = self.bounds(queries)
        open_pages = bound <= worst[:, None]
        counts = np.diff(seen.offsets.to_numpy())
        open_pages[np.repeat(np.arange(len(queries)), counts), seen.flatten().to_numpy()] = False
        found = []
        for row in range(len(queries)):
            at = np.flatnonzero(open_pages[row])
            if len(at) > step:
                at = at[np.lexsort((at, away[row, at], bound[row, at]))[:step]]
            found.append(at.astype(np.int32))
        return found


@dataclass(frozen=True)
class BallIndex:
    leaves: DataFrame  # the written leaf table
    nodes: Nodes
    size: int

    def search(self, queries: DataFrame, k: int, pages: int | None = None) -> DataFrame:
        """``knn(cell_idx, nn_rank, nn_cell_idx, dist)`` for ``(cell_idx, vec)``.

        Exact, or the best of the first ``pages`` pages of every query's order.
        """
        return _search(self, queries, min(k, self.size), pages)


def build_index(samples: DataFrame, metric: str = "cosine", page_rows: int = PAGE_ROWS, pivots: int | None = None) -> BallIndex:
    """Index ``(cell_idx, vec)``; pivots are taken by a hash of the id, as many as the root of the vectors unless given."""
    samples = materialize(samples.select("cell_idx", "vec"), "sample")
    n, width = samples.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no sampled cells to search")
    page_rows = max(page_rows, math.ceil(n / MAX_PAGES))
    most = max(1, MAX_PIVOTS // (8 * max(width, 1)))
    wanted = min(pivots or math.ceil(math.sqrt(n)), most, MAX_PAGES, n)
    held = samples.orderBy(F.xxhash64("cell_idx"), "cell_idx").limit(wanted).toArrow()
    centers = np.unique(prepared(list_matrix(held.column("vec")), metric), axis=0)
    shared = samples.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ASSIGNED_ROWS):
                batch = whole.slice(lo, ASSIGNED_ROWS)
                x = prepared(list_matrix(batch.column("vec")), metric)
                away = _euclidean(x, shared.value)
                ball = away.argmin(axis=1).astype(np.int32)
                r = np.take_along_axis(away, ball[:, None].astype(np.int64), axis=1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cell_idx"), pa.array(ball), pa.array(r), matrix_list(x)], ["cell_idx", "ball", "r", "vec"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def page(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            ids, r = rows.column("cell_idx").to_numpy(), rows.column("r").to_numpy()
            order = np.argsort(ids, kind="stable")  # ties of distances go by position
            vecs = list_matrix(rows.column("vec"))[order]
            columns = [[(part << 32) + made], [rows.column("ball")[0].as_py()], [float(r.min())], [float(r.max())], [len(ids)]]
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            packed = [matrix_list(ids[order][None, :]), matrix_list(vecs.reshape(1, -1))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)] + packed, ["page", "ball", "low", "high", "n", "ids", "vecs"]
            )

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            ball = table.column("ball").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(ball)) + 1, len(ball))
            at = 0
            for i, end in enumerate(cuts):
                while end - at > page_rows or (i + 1 < len(cuts) and end > at):
                    step = min(page_rows, end - at)
                    yield page(table.slice(at, step))
                    at += step
            held = table.slice(at).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield page(pa.Table.from_batches(held))

    placed = samples.mapInArrow(assign, "cell_idx long, ball int, r double, vec array<double>")
    order = ["ball", "r", "cell_idx"]
    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    leaves = materialize(sorted_rows.mapInArrow(pack, LEAVES), "leaves")
    table = leaves.select("page", "ball", "low", "high").orderBy("page").toArrow()  # bounded by MAX_PAGES, balls and partitions
    columns = [table.column(c).to_numpy() for c in ("page", "ball", "low", "high")]
    return BallIndex(leaves, Nodes(centers, *columns, metric), n)


def _search(index: BallIndex, queries: DataFrame, k: int, pages: int | None) -> DataFrame:
    spark = queries.sparkSession
    nodes = spark.sparkContext.broadcast(index.nodes)
    n_pages = len(index.nodes.page)
    limit = n_pages if pages is None else min(pages, n_pages)
    metric = index.nodes.metric

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                none = lambda kind: pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1, np.int32)), pa.array([], kind))  # noqa: B023,E731
                x = prepared(list_matrix(batch.column("vec")), metric)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cell_idx"), matrix_list(x), none(pa.int64()), none(pa.float64()), none(pa.int32())],
                    ["cell_idx", "vec", "nn", "dist", "seen"],
                )

    def plan(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
        """Every query's next pages; a query without any is done."""
        known = nodes.value
        rows = max(1, PLANNED // n_pages)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                seen = batch.column("seen")
                room = limit - np.diff(seen.offsets.to_numpy())
                found = known.next_pages(list_matrix(batch.column("vec")), seen, _worst(batch.column("dist"), k), step)
                found = [f[: max(r, 0)] for f, r in zip(found, room)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array([not len(f) for f in found])],
                    [*batch.schema.names, "next", "done"],
                )

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a batch that visit the same page, as one row."""
        known = nodes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, visits = list_matrix(batch.column("vec")), batch.column("cell_idx").to_numpy(), batch.column("next")
            page = visits.flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), np.diff(visits.offsets.to_numpy()))
            by_page = np.argsort(page, kind="stable")
            row, page = row[by_page], page[by_page]
            cuts = np.flatnonzero(np.diff(page)) + 1
            for rows in np.split(row, cuts):
                p = page[0]
                page = page[len(rows):]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([known.page[p]], pa.int64()), matrix_list(ids[rows][None, :]), matrix_list(x[rows].reshape(1, -1))],
                    ["visited", "cells", "points"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a page for the queries of a packet."""
        for batch in batches:
            for i in range(batch.num_rows):
                cells = batch.column("cells")[i].values.to_numpy()
                ids = batch.column("ids")[i].values.to_numpy()
                x = batch.column("points")[i].values.to_numpy().reshape(len(cells), -1)
                y = batch.column("vecs")[i].values.to_numpy().reshape(len(ids), -1)
                dist = distances(x, y, metric)
                best = smallest(dist, min(k, len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), matrix_list(ids[best]), matrix_list(np.take_along_axis(dist, best, axis=1))],
                    ["cell_idx", "nn", "dist"],
                )

    planned = STATE + ", next array<int>, done boolean"
    step, results = FIRST_PAGES, []
    first = queries.select("cell_idx", "vec").mapInArrow(start, STATE).mapInArrow(lambda b, s=step: plan(b, s), planned)
    state, now = materialize_with(first, "visits", left=F.count_if(~F.col("done")))
    while now["left"]:
        step = min(2 * step, MOST_PAGES)
        going = state.where("NOT done")
        visits = going.mapInArrow(packets, "visited long, cells array<long>, points array<double>")
        # few queries visit many pages, so neither side is small
        pages_seen = visits.join(index.leaves.hint("merge"), F.col("visited") == F.col("page")).select("cells", "points", "ids", "vecs")
        found = pages_seen.mapInArrow(compare, "cell_idx long, nn array<long>, dist array<double>")
        pairs = F.arrays_zip("dist", "nn")
        merged = found.groupBy("cell_idx").agg(F.flatten(F.collect_list(pairs)).alias("new"))
        best = F.slice(F.array_sort(F.concat(pairs, "new")), 1, k)
        moved = going.join(merged.hint("merge"), "cell_idx").select("cell_idx", "vec", best.alias("b"), F.concat("seen", "next").alias("seen"))
        moved = moved.select("cell_idx", "vec", F.col("b.nn").alias("nn"), F.col("b.dist").alias("dist"), "seen")
        state, now = materialize_with(moved.mapInArrow(lambda b, s=step: plan(b, s), planned), "visits", left=F.count_if(~F.col("done")))
        results.append(state.where("done"))
        if pages is None and now["left"]:
            results.append(materialize(_finished(index, state.where("NOT done"), now["left"], k), "finished"))
            break
    if not results:
        results = [state]
    every = results[0].select("cell_idx", "nn", "dist")
    for more in results[1:]:
        every = every.unionByName(more.select("cell_idx", "nn", "dist"))
    hit = F.posexplode(F.arrays_zip("nn", "dist")).alias("nn_rank", "hit")
    return every.select("cell_idx", hit).select(
        "cell_idx", (F.col("nn_rank") + 1).alias("nn_rank"), F.col("hit.nn").alias("nn_cell_idx"), F.col("hit.dist").alias("dist")
    )


def _error(width: int, kind: type) -> float:
    """Twice the bound of the relative error of a sum of products, with the rounding of their factors."""
    return (width + 8) * float(np.finfo(kind).eps)


class _Held:
    """Queries of a task and the best neighbours they found among the pages that came past."""

    def __init__(self, task: int, nodes: Nodes, k: int) -> None:
        self.task, self.nodes, self.k = task, nodes, k
        self.rows: list[pa.RecordBatch] = []
        self.x: np.ndarray | None = None

    def take(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)

    def _open(self) -> None:
        table = pa.Table.from_batches(self.rows)
        self.rows = []
        self.ids = list_matrix(table.column("ids"))[:, 0]
        self.x = list_matrix(table.column("vecs"))
        self.norm = (self.x**2).sum(axis=1)
        self.wide = self._wide(slice(None), np.float32)
        self.limit = table.column("worst").to_numpy().copy()  # of the pages seen before
        self.worst = self.limit.copy()
        self.seen = list_matrix(table.column("seen"))
        self.nn = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.dist = np.full((len(self.ids), self.k), np.inf)
        self.new: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def _wide(self, rows: np.ndarray | slice, kind: type) -> np.ndarray:
        """Queries with two columns more, whose products with those of the pages are half the page's norm and the greatest error."""
        x, norm = self.x[rows], self.norm[rows]
        return np.column_stack([x, np.ones(len(x)), np.sqrt(norm) * _error(x.shape[1], kind)]).astype(kind)

    def visit(self, rows: pa.RecordBatch) -> None:
        if self.x is None:
            self._open()
        sizes = np.diff(rows.column("ids").offsets.to_numpy())
        lo = 0
        while lo < len(sizes):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK_ROWS, "right")))
            chunk = rows.slice(lo, hi - lo)
            ids = chunk.column("ids").flatten().to_numpy()
            order = np.argsort(ids, kind="stable")
            vecs = chunk.column("vecs").flatten().to_numpy().reshape(len(ids), -1)[order]
            at = np.searchsorted(self.nodes.page, chunk.column("page").to_numpy())
            self._compare(at, np.repeat(np.arange(len(at)), sizes[lo:hi])[order], ids[order], vecs)
            lo = hi

    def _compare(self, at: np.ndarray, owner: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Pairs that may be near by a product in single precision, with its greatest error, are measured in full."""
        norm = (vecs**2).sum(axis=1)
        euclidean = self.nodes.metric == "euclidean"
        single = max(norm.max(), self.norm.max()) < SINGLE
        kind = np.float32 if single else np.float64
        half = norm / 2 * (_error(vecs.shape[1], kind) - 1) if euclidean else np.zeros(len(norm))
        wide = np.column_stack([vecs, half, np.sqrt(norm)]).astype(kind)
        for lo in range(0, len(self.ids), ASSIGNED_ROWS):
            some = slice(lo, lo + ASSIGNED_ROWS)
            seen = (self.seen[some, :, None] == at).any(axis=1)
            rows = np.flatnonzero((~seen & (self.nodes.bounds(self.x[some], at)[0] <= self.worst[some, None])).any(axis=1))
            if not len(rows):
                continue
            here = rows + lo
            most = self.worst[here] + 2 * 10.0**-DECIMALS
            least = (self.norm[here] - most**2) / 2 if euclidean else 1.0 - most
            mine = self.wide[here] if single else self._wide(here, kind)
            near = np.flatnonzero(mine @ wide.T >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None])
            row, other = np.divmod(near, len(ids))
            fresh = ~seen[rows[row], owner[other]]
            self._measure(lo, here[row[fresh]], other[fresh], ids, vecs)

    def _measure(self, lo: int, row: np.ndarray, other: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Keep pairs that are among the best by their distances, and settle a block of rows when many are kept."""
        for some in np.split(np.arange(len(row)), range(MEASURED, len(row), MEASURED)):
            r, o = row[some], other[some]
            if self.nodes.metric == "cosine":
                dist = 1.0 - np.einsum("ij,ij->i", self.x[r], vecs[o])
            else:
                dist = np.sqrt(((self.x[r] - vecs[o]) ** 2).sum(axis=1))
            dist, last, nn = np.round(dist, DECIMALS) + 0.0, self.dist[r, -1], ids[o]
            keep = (dist <= self.limit[r]) & ((dist < last) | ((dist == last) & (nn < self.nn[r, -1])))
            if keep.any():
                new = self.new.setdefault(lo, [])
                new.append((r[keep], nn[keep], dist[keep]))
                if sum(len(x[0]) for x in new) > max(MEASURED // 2, ASSIGNED_ROWS * self.k // 2):
                    self._settle(lo)

    def _settle(self, lo: int) -> None:
        """Merge what was kept for a block of rows into their best; ties go to the smaller id."""
        r, nn, dist = (np.concatenate(x) for x in zip(*self.new.pop(lo)))
        rows, place = np.unique(r, return_inverse=True)
        place = np.append(np.repeat(np.arange(len(rows)), self.k), place)
        nn, dist = np.append(self.nn[rows], nn), np.append(self.dist[rows], dist)
        order = np.lexsort((nn, dist, place))
        sizes = np.bincount(place)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        best = order[np.arange(len(order)) - first < self.k]
        self.nn[rows], self.dist[rows] = nn[best].reshape(-1, self.k), dist[best].reshape(-1, self.k)
        self.worst[rows] = np.minimum(self.limit[rows], self.dist[rows, -1])

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.x is None:  # no page came
            return
        for lo in list(self.new):
            self._settle(lo)
        for lo in range(0, len(self.ids), ASSIGNED_ROWS):
            some = slice(lo, lo + ASSIGNED_ROWS)
            dist = self.dist[some]
            held = np.isfinite(dist) & (dist <= self.limit[some, None])
            offsets = np.append(0, np.cumsum(held.sum(axis=1))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[held])) for v in (self.nn[some], dist)]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), *lists], ["cell_idx", "nn", "dist"])


def _finished(index: BallIndex, going: DataFrame, left: int, k: int) -> DataFrame:
    """``(cell_idx, nn, dist)`` of queries that are not done: the best of their state and of all pages they have not seen.

    A task holds a slice of the queries and sees a share of the pages, so that what is
    shuffled is pages x slices, queries x shares and the neighbours found in every share.
    """
    nodes = going.sparkSession.sparkContext.broadcast(index.nodes)
    n_pages, width = len(index.nodes.page), index.nodes.pivots.shape[1]
    least = math.ceil(left * (12 * width + 16 * k) / HELD_BYTES)
    tasks = max(least, min(TASKS, math.ceil(left * index.size / TASK_PAIRS)))
    shares = min(n_pages, SHARES, math.ceil(tasks / least))
    slices = max(least, math.ceil(tasks / shares))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    worst = F.when(F.size("dist") >= k, F.get("dist", F.lit(k - 1))).otherwise(F.lit(float("inf")))
    asked = going.select("*", each(shares).alias("share")).select(
        (part("cell_idx", slices) * shares + F.col("share")).cast("int").alias("task"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("page"),
        F.array("cell_idx").alias("ids"), F.col("vec").alias("vecs"), worst.alias("worst"), "seen",
    )
    passing = index.leaves.select("*", each(slices).alias("slice")).select(
        (F.col("slice") * shares + part("page", shares)).cast("int").alias("task"), F.lit(1).alias("kind"), "page",
        "ids", "vecs", F.lit(None).cast("double").alias("worst"), F.lit(None).cast("array<int>").alias("seen"),
    )
    rows = asked.unionByName(passing).repartitionById(slices * shares, F.col("task")).sortWithinPartitions("task", "kind", "page")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            task, kind = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(task) | np.diff(kind)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(task)]):
                if lo == hi:
                    continue
                if kind[lo] == 0 and (held is None or held.task != task[lo]):
                    if held is not None:
                        yield from held.found()
                    held = _Held(int(task[lo]), nodes.value, k)
                if held is not None and held.task == task[lo]:
                    (held.visit if kind[lo] else held.take)(batch.slice(lo, hi - lo))
        if held is not None:
            yield from held.found()

    found = rows.mapInArrow(stream, "cell_idx long, nn array<long>, dist array<double>")
    pairs = F.arrays_zip("dist", "nn")
    merged = found.where(F.size("nn") > 0).groupBy("cell_idx").agg(F.flatten(F.collect_list(pairs)).alias("new"))
    every = F.when(F.col("new").isNull(), pairs).otherwise(F.concat(pairs, "new"))
    best = F.slice(F.array_sort(every), 1, k)
    joined = going.join(merged.hint("merge"), "cell_idx", "left").select("cell_idx", best.alias("b"))
    return joined.select("cell_idx", F.col("b.nn").alias("nn"), F.col("b.dist").alias("dist"))


def _worst(dist: pa.ListArray, k: int) -> np.ndarray:
    """The distance of the k-th neighbour, infinite with fewer."""
    counts = np.diff(dist.offsets.to_numpy())
    flat = dist.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    worst = np.full(len(counts), np.inf)
    full = counts >= k
    worst[full] = flat[ends[full] - 1]
    return worst
