"""Layouts as tables: positions in blocks, forces along links, rounds of supersteps.

Cells are numbered in the order of their ids and cut into blocks of ``BLOCK``; a block is
one row that holds the positions of its cells. In a superstep every block receives what it
needs from the others: the positions its links lead to, those of a hashed draw of far
cells, or a field that all cells make up on a grid. It then moves its own cells for some
rounds while the received positions stand still. With one block nothing stands still and
all rounds are one superstep. Nothing is kept on the driver but the extent of the layout,
and no table that grows with the cells is broadcast through it.

Blocks depend on ids alone, draws on hashes of numbers and rounds, and lists are sorted
before they are summed, so a layout does not depend on how Spark partitions its tables.

A cell with more than ``HEAVY`` links (copies all choose the same neighbours) would make
its block too large: its forces are summed by a join and an aggregation over its links at
the start of every superstep instead, and kept for its rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.vectors import list_matrix, matrix_list
from cellweave.session import arrow_batches, materialize, materialize_with

BLOCK = 16_384

#: Bytes of the batches in which blocks travel to Python, one block at least.
BATCH_BYTES = 4 << 20
HEAVY = 512
PART_BITS = 33

#: Intervals a side of a grid at least and at most, their length where the bounds allow it, and the places
#: of a point's nodes in its interval.
INTERVALS, MOST_INTERVALS = 32, 320
INTERVAL = 0.8
PLACES = np.array([1, 3, 5, 7]) / 8

STATE = "block int, at array<double>, first array<double>, second array<double>"


def numbered(cells: DataFrame) -> DataFrame:
    """``(cell_idx, idx)``: cells numbered from 0 in the order of their ids, without one big window."""
    rows = cells.select("cell_idx").repartitionByRange("cell_idx").sortWithinPartitions("cell_idx")
    rows = materialize(rows.select("cell_idx", F.monotonically_increasing_id().alias("row")), "numbers")
    part, place = F.shiftright("row", PART_BITS), F.col("row").bitwiseAND((1 << PART_BITS) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select("cell_idx", (F.col("start") + place).alias("idx"))


def mixed(*parts) -> np.ndarray:
    """Well-spread 64-bit numbers from broadcastable whole numbers."""
    total = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            total = (total ^ np.asarray(part, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            total = total ^ (total >> np.uint64(32))
    return total


@dataclass
class Block:
    """What a block works on during a superstep."""

    base: int  # number of its first cell
    at: np.ndarray
    first: np.ndarray
    second: np.ndarray
    node: np.ndarray  # per link the place of the cell in the block, rising
    other: np.ndarray  # per link the place of the other end in ``around``
    weight: np.ndarray
    far: np.ndarray  # places of the drawn cells in ``around``
    halo: np.ndarray  # received positions
    steady: np.ndarray  # forces of heavy cells, last column the weight of their links

    @property
    def idx(self) -> np.ndarray:
        return self.base + np.arange(len(self.at))

    def around(self) -> np.ndarray:
        return np.vstack([self.at, self.halo])

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.node, v, len(self.at)) for v in values.T], axis=1).astype(float)


class Layout:
    """Positions, links and what the blocks need of each other, as written tables."""

    def __init__(self, start: DataFrame, links: DataFrame, components: int, pull: Callable, draws: int = 0, seed: int = 0, block_size: int = BLOCK, heavy_links: int = HEAVY):
        """``start(cell_idx, vec)``, ``links(node, other, weight)`` in both directions; ``pull(diff, weight)`` is a link's force."""
        self.components, self.pull, self.draws, self.seed = components, pull, draws, seed
        self.numbers = materialize(numbered(start), "numbers")
        self.n, self.block_size = self.numbers.count(), block_size
        self.n_blocks = -(-self.n // block_size)
        block = lambda c: F.expr(f"cast({c} div {block_size} as int)")
        placed = start.join(self.numbers.hint("merge"), "cell_idx").groupBy(block("idx").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("s")
        )
        zeros = F.transform("at", lambda x: F.lit(0.0))
        self.state = placed.select("block", F.flatten("s.vec").alias("at")).select("block", "at", zeros.alias("first"), zeros.alias("second"))
        ends = links
        for end, name in (("node", "idx"), ("other", "to")):
            ends = ends.join(self.numbers.select(F.col("cell_idx").alias(end), F.col("idx").alias(name)).hint("merge"), end)
        ends = materialize(ends.select(block("idx").alias("block"), "idx", "to", "weight"), "links")
        heavy, seen = materialize_with(ends.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_links), "heavy", n=F.count(F.lit(1)))
        self.heavy_links = materialize(ends.join(heavy.hint("merge"), "idx", "left_semi"), "heavy-links") if seen["n"] else None
        light = ends.join(heavy.hint("merge"), "idx", "left_anti") if seen["n"] else ends
        listed = light.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "to", "weight"))).alias("e"))
        self.edges = materialize(listed.select("block", F.col("e.idx").alias("node"), F.col("e.to").alias("to"), F.col("e.weight").alias("weight")), "block-links")
        away = light.where(F.col("block") != block("to")).select("block", F.col("to").alias("idx")).distinct()
        self.needs = materialize(away, "needs")
        self.box: list[float] | None = None  # least and greatest coordinates, known after a superstep

    def supersteps(self, rounds: int, inner: int) -> list[tuple[int, int]]:
        """``(first round, rounds)`` of every superstep."""
        step = rounds if self.n_blocks == 1 and self.heavy_links is None else inner
        return [(t, min(step, rounds - t)) for t in range(0, rounds, step)]

    @property
    def _drawn(self) -> Callable[[int, int], np.ndarray]:
        """Numbers of the far cells that a block draws for a superstep."""
        seed, draws, n = self.seed, self.draws, self.n
        return lambda block, turn: (mixed(seed, 1, turn, block, np.arange(draws)) % np.uint64(n)).astype(np.int64)

    def positions(self) -> DataFrame:
        """``(idx, vec)``"""
        c, size = self.components, self.block_size

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    at = batch.column("at")[i].values.to_numpy().reshape(-1, c)
                    idx = batch.column("block")[i].as_py() * size + np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(idx), matrix_list(at)], ["idx", "vec"])

        return self.state.select("block", "at").mapInArrow(opened, "idx long, vec array<double>")

    def _received(self, turn: int) -> DataFrame | None:
        """``(block, halo)``: numbers and positions that come from other blocks."""
        if self.n_blocks == 1:
            return None
        asked = self.needs
        if self.draws:
            drawn, size = self._drawn, self.block_size

            def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for b in batch.column(0).to_pylist():
                        idx = np.unique(drawn(b, turn))
                        idx = idx[idx // size != b]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), b, np.int32)), pa.array(idx)], ["block", "idx"])

            asked = asked.union(self.state.select("block").mapInArrow(draw, "block int, idx long")).distinct()
        return asked.join(self.positions().hint("merge"), "idx").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("halo"))

    def _steady(self) -> DataFrame | None:
        """``(block, steady)``: summed forces of the heavy cells."""
        if self.heavy_links is None:
            return None
        here = self.positions()
        pull, c = self.pull, self.components
        both = self.heavy_links.join(here.withColumnRenamed("vec", "mine").hint("merge"), "idx").join(
            here.select(F.col("idx").alias("to"), F.col("vec").alias("yours")).hint("merge"), "to"
        )

        def forces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    w = batch.column("weight").to_numpy()
                    f = pull(list_matrix(batch.column("mine")) - list_matrix(batch.column("yours")), w)
                    columns = [pa.array(np.round(f[:, i], 12)) for i in range(c)]
                    yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("idx"), *columns, batch.column("weight")], names)

        names = ["block", "idx", *(f"f{i}" for i in range(c)), "weight"]
        parts = both.select("block", "idx", "mine", "yours", "weight").mapInArrow(
            forces, "block int, idx long, " + ", ".join(f"f{i} double" for i in range(c)) + ", weight double"
        )
        # decimal sums do not depend on the order of the links
        exact = lambda x: F.sum(F.col(x).cast("decimal(30,12)")).cast("double")
        sums = parts.groupBy("block", "idx").agg(F.array(*(exact(x) for x in names[2:])).alias("f"))
        return sums.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "f"))).alias("steady"))

    def advance(self, move: Callable[[Block, int, int, dict | None], None], turn: int, rounds: int, field: DataFrame | None = None) -> None:
        """Let every block move its cells for some rounds; ``move(block, turn, rounds, field)`` changes the block in place."""
        joined, columns = self.state.join(self.edges.hint("merge"), "block", "left"), ["block", "at", "first", "second", "node", "to", "weight"]
        for name, more in (("halo", self._received(turn)), ("steady", self._steady())):
            if more is None:
                joined = joined.withColumn(name, F.lit(None))
            else:
                joined = joined.join(more.hint("merge"), "block", "left").select(
                    *joined.columns, F.col(f"{name}.idx").alias(f"{name}_idx"), F.col(f"{name}.{'vec' if name == 'halo' else 'f'}").alias(name)
                )
        if field is not None:  # one row of bounded size, which tasks read from its table and not from the driver
            joined = joined.crossJoin(field.coalesce(1).hint("shuffle_replicate_nl"))
        c, drawn, draws, size = self.components, self._drawn, self.draws, self.block_size
        field_columns = field.columns if field is not None else []
        kept = [x for x in joined.columns if not (x in ("halo", "steady") and f"{x}_idx" not in joined.columns)]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i] for name in kept}
                    values = lambda name: row[name].values.to_numpy(zero_copy_only=False) if name in row and row[name].is_valid else np.empty(0)  # noqa: B023,E731
                    grid = lambda name: values(name).reshape(-1, c)  # noqa: B023,E731
                    number = row["block"].as_py()
                    at, base = grid("at").copy(), number * size
                    halo_idx = values("halo_idx").astype(np.int64)
                    nested = row.get("halo")
                    halo = nested.values.flatten().to_numpy().reshape(-1, c) if nested is not None and nested.is_valid else np.empty((0, c))

                    def place(idx: np.ndarray) -> np.ndarray:
                        own = (idx >= base) & (idx < base + len(at))  # noqa: B023
                        return np.where(own, idx - base, len(at) + np.searchsorted(halo_idx, idx))  # noqa: B023

                    steady = np.zeros((len(at), c + 1))
                    if "steady_idx" in row and row["steady_idx"].is_valid:
                        steady[values("steady_idx").astype(np.int64) - base] = row["steady"].values.flatten().to_numpy().reshape(-1, c + 1)
                    block = Block(
                        base, at, grid("first").copy(), grid("second").copy(), values("node").astype(np.int64) - base,
                        place(values("to").astype(np.int64)), values("weight").astype(float),
                        place(drawn(number, turn)) if draws else np.empty(0, np.int64), halo, steady,
                    )
                    given = {f: row[f].values.to_numpy() if hasattr(row[f], "values") else row[f].as_py() for f in field_columns} or None
                    move(block, turn, rounds, given)
                    box = block.at.min(axis=0), block.at.max(axis=0)
                    packed = [matrix_list(x.reshape(1, -1)) for x in (block.at, block.first, block.second, *box)]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *packed], ["block", "at", "first", "second", "low", "high"])

        blocks = joined.select(*kept)
        with arrow_batches(blocks.sparkSession, BATCH_BYTES):
            moved, seen = materialize_with(
                blocks.mapInArrow(step, f"{STATE}, low array<double>, high array<double>"), "layout",
                **{f"{end}{i}": f(F.col(end)[i]) for end, f in (("low", F.min), ("high", F.max)) for i in range(c)},
            )
        self.state = moved.drop("low", "high")
        self.box = [seen[f"{end}{i}"] for end in ("low", "high") for i in range(c)]

    def result(self) -> DataFrame:
        """``(cell_idx, vec)``"""
        return self.positions().join(self.numbers.hint("merge"), "idx").select("cell_idx", "vec")


@lru_cache(maxsize=2)
def kernel_transforms(side: int, gap: float) -> np.ndarray:
    """Fourier transforms of the kernel and its square over the differences of nodes."""
    size = 2 * side
    away = np.minimum(np.arange(size), size - np.arange(size)) * gap
    near = 1 / (1 + away[:, None] ** 2 + away[None, :] ** 2)
    return np.fft.rfft2(np.stack([near, near**2]))


@dataclass(frozen=True)
class Grid:
    """Equally spaced nodes over a square of the plane, four to an interval a side.

    Charges are spread to the sixteen nodes of a point's square by Lagrange polynomials, node
    sums are convolved with a kernel, and potentials are read back with the same weights;
    the cost is linear in the points.
    """

    low: tuple[float, float]
    step: float  # length of an interval
    intervals: int

    @classmethod
    def over(cls, low, high, spare: float = 0.0, least: float = 1e-9) -> Grid:
        """The square around the points, widened by a share and to a least side."""
        span = max(float(max(h - b for b, h in zip(low, high))) * (1 + 2 * spare), least)
        n = -(-max(INTERVALS, int(np.ceil(span / INTERVAL))) // 8) * 8
        step = INTERVAL if INTERVALS * INTERVAL <= span <= MOST_INTERVALS * INTERVAL else span / min(n, MOST_INTERVALS)
        n = min(n, MOST_INTERVALS)
        middle = [(b + h) / 2 for b, h in zip(low, high)]
        return cls((middle[0] - n * step / 2, middle[1] - n * step / 2), step, n)

    @property
    def side(self) -> int:
        return len(PLACES) * self.intervals

    def nodes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(points x 16 node numbers, points x 16 weights)``"""
        u = np.clip((at - np.array(self.low)) / self.step, 0, self.intervals)
        cell = np.clip(np.floor(u), 0, self.intervals - 1)
        t = (u - cell)[:, :, None] - PLACES
        weight = np.empty_like(t)
        places = t.transpose(2, 0, 1).copy()
        for k, place in enumerate(PLACES):
            a, b, c = np.delete(np.arange(len(PLACES)), k)
            weight[:, :, k] = places[a] * places[b] * places[c] / (place - PLACES[[a, b, c]]).prod()
        node = (len(PLACES) * cell.astype(np.int64))[:, :, None] + np.arange(len(PLACES))
        both = node[:, 0, :, None] * self.side + node[:, 1, None, :]
        return both.reshape(len(at), -1), (weight[:, 0, :, None] * weight[:, 1, None, :]).reshape(len(at), -1)

    def spread(self, at: np.ndarray, charges: np.ndarray, nodes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """``(charges, nodes)`` sums of points x charges; ``nodes`` are those of the points if known."""
        node, weight = nodes or self.nodes(at)
        return np.stack([np.bincount(node.ravel(), (weight * q[:, None]).ravel(), self.side**2) for q in charges.T])

    def potentials(self, sums: np.ndarray) -> np.ndarray:
        """Node potentials: of the kernel ``1/(1+d^2)`` for the first charge, of its square for all."""
        side, size = self.side, 2 * self.side
        kernels = kernel_transforms(side, self.step / len(PLACES))
        # along rows only where there are sums, and where potentials are wanted
        charges = np.fft.fft(np.fft.rfft(sums.reshape(-1, side, side), n=size, axis=2), n=size, axis=1)
        both = np.concatenate([charges[:1] * kernels[0], charges * kernels[1]])
        return np.fft.irfft(np.fft.ifft(both, axis=1)[:, :side], n=size, axis=2)[:, :, :side].reshape(len(both), -1)

    def read(self, potentials: np.ndarray, at: np.ndarray, nodes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        node, weight = nodes or self.nodes(at)
        return np.stack([(p[node] * weight).sum(axis=1) for p in potentials], axis=1)


def charges(at: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(at)), at])


def repulsion(at: np.ndarray, read: np.ndarray) -> np.ndarray:
    """``sum over j of (y_i - y_j) / (1 + d^2)^2`` from read potentials (near, near^2, x near^2, y near^2)."""
    return at * read[:, 1:2] - read[:, 2:4]


FIELD = "low_x double, low_y double, step double, intervals int, z double, potentials array<double>"


def field_of(layout: Layout, grid: Grid) -> DataFrame:
    """One row: the potentials of all cells on the grid, and the sum of the kernel over all pairs.

    Blocks send sums by node; one task holds the grid, whose size is bounded, never the cells.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("at")[i].values.to_numpy().reshape(-1, 2)
                sums = grid.spread(at, charges(at))
                node = np.flatnonzero(np.abs(sums).any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), *(pa.array(np.round(s[node], 12)) for s in sums)], ["node", "q0", "q1", "q2"]
                )

    def convolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, grid.side**2))
        for batch in batches:
            node = batch.column("node").to_numpy()
            for k in range(3):
                sums[k, node] = batch.column(f"q{k}").to_numpy()
        found = grid.potentials(sums)
        z = float(sums[0] @ found[0])
        columns = [[grid.low[0]], [grid.low[1]], [grid.step], [grid.intervals], [z]]
        kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
        names = ["low_x", "low_y", "step", "intervals", "z", "potentials"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)] + [matrix_list(found.reshape(1, -1))], names)

    sums = layout.state.select("at").mapInArrow(spread, "node long, q0 double, q1 double, q2 double")
    # decimal sums do not depend on the order of the blocks
    exact = lambda x: F.sum(F.col(x).cast("decimal(35,12)")).cast("double").alias(x)
    nodes = sums.groupBy("node").agg(*(exact(f"q{k}") for k in range(3)))
    return materialize(nodes.repartition(1).mapInArrow(convolve, FIELD), "field")


def extent(layout: Layout) -> tuple[list[float], list[float]]:
    """Least and greatest coordinates."""
    if layout.box is not None:
        return layout.box[:2], layout.box[2:]
    places = F.filter("at", lambda x, i: i % 2 == 0), F.filter("at", lambda x, i: i % 2 == 1)
    row = layout.state.agg(*(f(g(x)) for x in places for f, g in ((F.min, F.array_min), (F.max, F.array_max)))).first()
    return [row[0], row[2]], [row[1], row[3]]
