"""Average-linkage clustering of a bounded sample and an adaptive cut of its tree.

The tree is the full one: all angles between the sampled cells, grown by chains of
nearest neighbours with averaged distances. The cut looks at the shape of branches: two
branches that meet stay apart if both are large enough, have a tight core, and the gap
between the core's scatter and the height where they meet is wide enough. What belongs
to no cluster then goes to the nearest cluster of its part of the tree.

The tree needs all pairs, so it is grown on at most ``FIT_CELLS`` cells, taken by a hash
of their ids; other cells follow the majority of their nearest fitted cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.hashing import take_by_hash
from cellweave.operators.ballindex import prepared
from cellweave.operators.graph import number_by_size
from cellweave.operators.knn import nearest
from cellweave.operators.vectors import list_matrix
from cellweave.session import materialize

#: Cells the tree is grown on at most; a task holds their distances twice (400 MB).
FIT_CELLS = 5_000

#: Nearest fitted cells whose majority other cells follow.
VOTERS = 10

# The cut lies at this share between a low quantile of the merge heights and
# the highest merge; smaller branches are not clusters of their own. By depth of splitting:
# the greatest scatter of a core, as a share of the same range; a gap is three quarters of the rest.
CUT_SHARE = 0.99
LOW_HEIGHT = 0.05
MIN_CLUSTER_SIZE = 20
DEEP_SPLIT = 1
CORE_SCATTER = (0.64, 0.73, 0.82, 0.91, 0.95)

TREE = "child long, parent long, height double, cell_idx long, label long"


def angles(vectors: np.ndarray) -> np.ndarray:
    """Angles over pi between all rows; a zero row is at a right angle to all others."""
    unit = prepared(vectors, "cosine")
    found = np.arccos(np.clip(unit @ unit.T, -1.0, 1.0)) / math.pi
    found = np.round((found + found.T) / 2, 12)
    np.fill_diagonal(found, 0.0)
    return found


def chain_merges(distances: np.ndarray) -> list[tuple[int, int, float]]:
    """``(kept, joined, height)`` of average linkage by rising height; a cluster is known by its first row.

    A chain goes from a cluster to its nearest until two are each other's nearest, which
    then merge; averaging never brings clusters closer, so the rest of the chain stays valid.
    """
    d = distances.copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    size = np.ones(n)
    alive = np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            row = d[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((a, b, float(d[a, b])))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        joined[[a, b]] = np.inf
        d[a], d[:, a] = joined, joined
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: (m[2], m[0], m[1]))


class _Branch:
    """A part of the tree: a basic one with its members in the order they joined, or one made of basic ones."""

    def __init__(self, members: list[int]):
        self.members = members
        self.parts: list[_Branch] = []  # basic branches that stay apart
        self.loose: list[int] = []  # cells that belong to none of the parts
        self.top = math.nan  # height where a basic branch met what it stays apart from

    @property
    def basic(self) -> bool:
        return not self.parts


def core_scatter(members: list[int], distances: np.ndarray, least: int) -> float:
    """Mean distance between the first members of a branch; the core grows with the root of the branch."""
    base = least // 2 + 1
    size = int(base + math.sqrt(len(members) - base)) if base < len(members) else len(members)
    core = members[:size]
    return distances[np.ix_(core, core)].sum() / (size * (size - 1)) if size > 1 else 0.0


def cut_heights(heights: np.ndarray) -> tuple[float, float]:
    """The low height that scatters and gaps are measured from, and the height of the cut."""
    low = float(np.sort(heights)[max(round(len(heights) * LOW_HEIGHT), 1) - 1])
    return low, low + CUT_SHARE * (float(heights.max()) - low)


def adaptive_cut(
    distances: np.ndarray,
    merges: list[tuple[int, int, float]],
    least: int = MIN_CLUSTER_SIZE,
    deep_split: int = DEEP_SPLIT,
    cut_height: float | None = None,
) -> np.ndarray:
    """Labels from 1, larger clusters first, 0 for cells of parts of the tree without a cluster."""
    n = len(distances)
    if n < 2:
        return np.zeros(n, np.int64)
    low, cut = cut_heights(np.array([m[2] for m in merges]))
    cut = cut if cut_height is None else cut_height
    most_scatter = low + CORE_SCATTER[deep_split] * (cut - low)
    least_gap = (1 - CORE_SCATTER[deep_split]) * 0.75 * (cut - low)

    def fails(branch: _Branch, height: float) -> bool:
        scatter = core_scatter(branch.members, distances, least)
        return len(branch.members) < least or scatter > most_scatter or height - scatter < least_gap

    at: dict[int, _Branch | int] = {i: i for i in range(n)}  # first row of a cluster -> its branch, or the cell itself
    for a, b, height in merges:
        if height > cut:
            break
        x, y = at[a], at.pop(b)
        if isinstance(x, int) and isinstance(y, int):
            at[a] = _Branch([x, y])
        elif isinstance(x, int) or isinstance(y, int):
            branch, cell = (y, x) if isinstance(x, int) else (x, y)
            (branch.members if branch.basic else branch.loose).append(cell)
            at[a] = branch
        else:
            small, large = (x, y) if len(_cells(x)) <= len(_cells(y)) else (y, x)
            if not (small.basic and fails(small, height)) and large.basic and fails(large, height):
                small, large = large, small
            if small.basic and fails(small, height):
                (large.members if large.basic else large.loose).extend(small.members)
                at[a] = large
            else:
                both = _Branch([])
                for branch in (small, large):
                    if branch.basic:
                        branch.top = height
                    both.parts += [branch] if branch.basic else branch.parts
                    both.loose += [] if branch.basic else branch.loose
                at[a] = both

    labels = np.zeros(n, np.int64)
    clusters: list[list[int]] = []
    regions: list[tuple[list[int], list[int]]] = []  # clusters and spare cells of one part of the tree
    for branch in at.values():
        if isinstance(branch, int):
            continue
        parts = [branch] if branch.basic else branch.parts
        spare, own = list(branch.loose), []
        for part in parts:
            if fails(part, cut if math.isnan(part.top) else part.top):
                spare += part.members
            else:
                own.append(len(clusters))
                clusters.append(part.members)
        regions.append((own, spare))
    for number, members in enumerate(clusters, 1):
        labels[members] = number
    for own, spare in regions:
        if own and spare:
            away = np.stack([distances[np.ix_(spare, clusters[c])].mean(axis=1) for c in own], axis=1)
            near = away.argmin(axis=1)
            # a cluster takes what is within its own widest mean distance, or below the cut
            wide = np.array([max(cut, (distances[np.ix_(clusters[c], clusters[c])].sum(axis=1) / max(len(clusters[c]) - 1, 1)).max()) for c in own])
            fits = away[np.arange(len(spare)), near] <= wide[near]
            labels[np.array(spare)[fits]] = np.array(own)[near[fits]] + 1
    order = sorted(range(1, len(clusters) + 1), key=lambda c: (-(labels == c).sum(), int(np.flatnonzero(labels == c)[0])))
    renamed = np.zeros(len(clusters) + 1, np.int64)
    renamed[order] = np.arange(1, len(order) + 1)
    return renamed[labels]


def _cells(branch: _Branch) -> list[int]:
    return branch.members if branch.basic else [c for p in branch.parts for c in p.members] + branch.loose


def grow_tree(vectors: DataFrame, **cut) -> DataFrame:
    """Merges ``(child, parent, height)`` and labels ``(cell_idx, label)`` of a bounded sample, as rows of one table.

    A cluster carries the id of its smallest cell.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("cell_idx")
        ids = table.column("cell_idx").to_numpy()
        distances = angles(list_matrix(table.column("vec")))
        merges = chain_merges(distances)
        labels = adaptive_cut(distances, merges, **cut)
        rows, n = len(merges), len(ids)
        pad = lambda values, kind, before, after: pa.concat_arrays([pa.nulls(before, kind), pa.array(values, kind), pa.nulls(after, kind)])
        child, parent = ([int(ids[m[i]]) for m in merges] for i in (1, 0))
        yield pa.RecordBatch.from_arrays(
            [
                pad(child, pa.int64(), 0, n),
                pad(parent, pa.int64(), 0, n),
                pad([m[2] for m in merges], pa.float64(), 0, n),
                pad(ids, pa.int64(), rows, 0),
                pad(labels, pa.int64(), rows, 0),
            ],
            ["child", "parent", "height", "cell_idx", "label"],
        )

    return materialize(vectors.select("cell_idx", "vec").repartition(1).mapInArrow(grow, TREE), "tree")


def tree_merges(tree: DataFrame) -> DataFrame:
    return tree.where("child IS NOT NULL").select("child", "parent", "height")


def fit_sample(vectors: DataFrame, fit_cells: int = FIT_CELLS, seed: int = 0) -> DataFrame:
    """All cells, or ``fit_cells`` of them by a hash of their ids where there are more."""
    if vectors.count() <= fit_cells:
        return vectors
    drawn = take_by_hash(vectors.select("cell_idx"), "cell_idx", fit_cells, seed=seed)
    return materialize(vectors.join(drawn.select("cell_idx"), "cell_idx", "left_semi"), "fit")


def hierarchical_labels(
    vectors: DataFrame,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    deep_split: int = DEEP_SPLIT,
    cut_height: float | None = None,
    fit_cells: int = FIT_CELLS,
    seed: int = 0,
) -> DataFrame:
    """``(cell_idx, label)``, label 1 the largest; 0 for cells in parts of the tree without a cluster."""
    vectors = materialize(vectors.select("cell_idx", "vec"), "vectors")
    sample = fit_sample(vectors, fit_cells, seed)
    tree = grow_tree(sample, least=min_cluster_size, deep_split=deep_split, cut_height=cut_height)
    labels = tree.where("cell_idx IS NOT NULL").select("cell_idx", "label")
    if sample is vectors:
        return labels
    others = vectors.join(sample.select("cell_idx"), "cell_idx", "left_anti")
    votes = (
        nearest(others, sample, VOTERS)
        .join(labels.select(F.col("cell_idx").alias("nn_cell_idx"), "label"), "nn_cell_idx")
        .groupBy("cell_idx", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cell_idx")
        .agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    )
    every = materialize(labels.unionByName(votes), "labels")
    numbered = number_by_size(every.where("label > 0").select(F.col("cell_idx").alias("node"), F.col("label").alias("community")))
    named = numbered.select(F.col("node").alias("cell_idx"), F.col("community").cast("long").alias("label"))
    return named.unionByName(every.where("label = 0").select("cell_idx", "label"))
