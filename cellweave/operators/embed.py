"""Two-dimensional layouts of cells and projection of others into them.

Layouts keep their positions in tables: blocks of cells move along the links of the
neighbour graph, for UMAP pushed off by hashed draws of far cells, for t-SNE by a field
that all cells make up on a grid. The driver holds no positions and the number of cells
has no bound. Neighbour weights are built with joins and aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.model import Experiment
from cellweave.operators.cluster import selected_genes
from cellweave.operators.knn import nearest
from cellweave.operators.layout import BLOCK, INTERVAL, INTERVALS, Block, Grid, Layout, charges, extent, field_of, mixed, repulsion
from cellweave.operators.pca_genes import principal_components
from cellweave.operators.vectors import dense_vectors, list_matrix, matrix_list
from cellweave.session import materialize

# Perplexity of the t-SNE layout and neighbours per perplexity.
PERPLEXITY = 15
NEIGHBOURS_PER_PERPLEXITY = 3


def neighbour_lists(knn: DataFrame, keep: int) -> DataFrame:
    """``(cell_idx, nn, dist)`` lists of at most ``keep`` others, nearest first.

    A cell with many copies may be missing among its own nearest, so lists are cut to one length.
    """
    hits = F.array_sort(F.collect_list(F.struct("dist", F.col("nn_cell_idx").alias("nn"))))
    listed = knn.where(F.col("cell_idx") != F.col("nn_cell_idx")).groupBy("cell_idx").agg(hits.alias("h"))
    cut = listed.select("cell_idx", F.slice("h", 1, keep).alias("h"))
    return cut.select("cell_idx", F.col("h.nn").alias("nn"), F.col("h.dist").alias("dist"))


def _solve(dist: np.ndarray, total: Callable[[np.ndarray], np.ndarray], goal: float) -> np.ndarray:
    """Per row, the scale at which a growing function of it meets ``goal``, by bisection."""
    low, high = np.full(len(dist), 1e-12), np.full(len(dist), 1e12)
    for _ in range(80):
        mid = np.sqrt(low * high)
        above = total(mid) > goal
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return np.sqrt(low * high)


def fuzzy_weights(dist: np.ndarray) -> np.ndarray:
    """Membership of the neighbours: 1 at the nearest, the row sum is log2 of k."""
    rho = np.where(dist > 0, dist, np.inf).min(axis=1, keepdims=True)
    away = np.maximum(dist - np.where(np.isfinite(rho), rho, 0.0), 0.0)
    sigma = _solve(away, lambda s: np.exp(-away / s[:, None]).sum(axis=1), math.log2(dist.shape[1] + 1))
    return np.exp(-away / sigma[:, None])


def perplexity_weights(dist: np.ndarray) -> np.ndarray:
    """Gaussian neighbour probabilities whose entropy is that of the perplexity."""
    squared = dist**2 - (dist**2).min(axis=1, keepdims=True)
    goal = math.log(max(1.0, min(PERPLEXITY, dist.shape[1] / NEIGHBOURS_PER_PERPLEXITY)))

    def entropy(scale: np.ndarray) -> np.ndarray:
        p = np.exp(-squared / scale[:, None])
        z = p.sum(axis=1)
        return np.log(z) + (p * squared).sum(axis=1) / (z * scale)

    p = np.exp(-squared / _solve(squared, entropy, goal)[:, None])
    return p / p.sum(axis=1, keepdims=True)


def weighted_neighbours(knn: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], keep: int) -> DataFrame:
    """``(cell_idx, nn, weight)`` lists; a row's weights depend on its own distances only."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # rounded far above the last digits, which depend on how rows are batched
                w = np.round(weigh(list_matrix(batch.column("dist"))), 8)
                yield pa.RecordBatch.from_arrays([batch.column("cell_idx"), batch.column("nn"), matrix_list(w)], ["cell_idx", "nn", "weight"])

    # equal list lengths: every cell has the same number of neighbours
    return neighbour_lists(knn, keep).mapInArrow(apply, "cell_idx long, nn array<long>, weight array<double>")


def _both_sides(weighted: DataFrame, combine) -> DataFrame:
    """``(node, other, weight)`` in both directions after combining the two one-way weights."""
    pairs = weighted.select("cell_idx", F.explode(F.arrays_zip("nn", "weight")).alias("z")).select(
        F.least("cell_idx", "z.nn").alias("a"), F.greatest("cell_idx", "z.nn").alias("b"), F.col("z.weight").alias("w")
    )
    total, both = F.sum("w"), F.when(F.count(F.lit(1)) == 2, F.min("w") * F.max("w")).otherwise(0.0)
    joined = pairs.groupBy("a", "b").agg(combine(total, both).alias("weight"))
    return joined.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "weight"),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "weight"),
    )).alias("e")).select("e.*")


def starting_positions(vectors: DataFrame, components: int, scale: float, seed: int) -> DataFrame:
    """``(cell_idx, vec)``: leading principal components of one overall scale, with a little noise by a hash of the id."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dims = min(components, width, max(1, n - 1))
    scores = materialize(principal_components(vectors, dims)[0], "start")
    spread = max((x or 0.0 for x in scores.agg(*(F.stddev_pop(F.col("vec")[i]) for i in range(dims))).first()), default=0.0)
    # rounded, so that sums taken in another order give the same start
    place = [F.round(F.col("vec")[i] * (scale / max(spread, 1e-12)), 8) if i < dims else F.lit(0.0) for i in range(components)]
    noise = [(F.pmod(F.xxhash64("cell_idx", F.lit(seed), F.lit(i)), F.lit(2_000_001)) / 1_000_000 - 1) * (scale * 1.7e-3) for i in range(components)]
    return scores.select("cell_idx", F.array(*(p + e for p, e in zip(place, noise))).alias("vec"))


def umap_links(vectors: DataFrame, n_neighbors: int = 15, metric: str = "euclidean") -> DataFrame:
    """``(node, other, weight)`` in both directions: the union of the memberships of two cells in each other's neighbourhood."""
    knn = nearest(vectors, vectors, n_neighbors + 1, metric)
    return _both_sides(weighted_neighbours(knn, fuzzy_weights, n_neighbors), lambda total, both: total - both)


def tsne_links(vectors: DataFrame, n: int) -> DataFrame:
    """``(node, other, weight)`` in both directions: mean neighbour probability of ``n`` cells, all weights sum to one."""
    k = PERPLEXITY * NEIGHBOURS_PER_PERPLEXITY
    knn = nearest(vectors, vectors, min(n, k + 1), "euclidean")
    return _both_sides(weighted_neighbours(knn, perplexity_weights, k), lambda total, both: total / (2.0 * n))


def curve_parameters(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + a d^(2b))`` closest to the wanted falling curve."""
    d = np.linspace(1e-3, 3 * spread, 300)
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a_grid, b_grid = np.geomspace(1e-2, 20, 60), np.linspace(0.2, 2.5, 60)
    for _ in range(4):
        curve = 1 / (1 + a_grid[:, None, None] * d ** (2 * b_grid[None, :, None]))
        i, j = np.unravel_index(((curve - goal) ** 2).sum(axis=2).argmin(), (60, 60))
        a, b = a_grid[i], b_grid[j]
        a_grid, b_grid = np.linspace(a * 0.8, a * 1.25, 60), np.linspace(b * 0.9, b * 1.1, 60)
    return float(a), float(b)


def umap_pull(a: float, b: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def pull(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
        d2 = np.maximum((diff**2).sum(axis=1, keepdims=True), 1e-12)
        return np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * diff, -4, 4) * w[:, None]

    return pull


def umap_push(mine: np.ndarray, far: np.ndarray, a: float, b: float) -> np.ndarray:
    """Mean repulsion of ``far`` (cells x draws x dimensions)."""
    away = mine[:, None, :] - far
    f2 = (away**2).sum(axis=2, keepdims=True)
    return np.clip(2 * b / ((0.001 + f2) * (1 + a * f2**b)) * away, -4, 4).mean(axis=1)


#: Far cells a block draws for a superstep, and rounds of a superstep while other blocks stand still.
DRAWS = 4096
UMAP_INNER, TSNE_INNER = 5, 10


def fit_umap(
    vectors: DataFrame,
    components: int = 2,
    n_neighbors: int = 15,
    min_dist: float = 0.01,
    metric: str = "euclidean",
    n_epochs: int = 100,
    negative_sample_rate: int = 5,
    learning_rate: float = 1.0,
    seed: int = 0,
    block_size: int = BLOCK,
) -> DataFrame:
    """``(cell_idx, vec)``: neighbour-graph layout of all cells given."""
    vectors = materialize(vectors.select("cell_idx", "vec"), "umap")
    links = umap_links(vectors, n_neighbors, metric)
    a, b = curve_parameters(min_dist)
    pull = umap_pull(a, b)
    start = starting_positions(vectors, components, 5.0, seed)
    layout = Layout(start, links, components, pull, DRAWS, seed, block_size)

    def move(block: Block, turn: int, rounds: int, field: dict | None) -> None:
        strength = block.sums(block.weight[:, None]) + block.steady[:, -1:]
        picks = np.arange(2 * negative_sample_rate)[None, :]
        for t in range(turn, turn + rounds):  # batch updates with averaged moments
            around = block.around()
            drawn = block.far[(mixed(seed, 2, t, block.idx[:, None], picks) % np.uint64(len(block.far))).astype(np.int64)]
            push = umap_push(block.at, around[drawn], a, b)
            grad = block.sums(pull(block.at[block.node] - around[block.other], block.weight))
            grad += block.steady[:, :-1] + negative_sample_rate * strength * push
            block.first, block.second = 0.5 * block.first + 0.5 * grad, 0.9 * block.second + 0.1 * grad**2
            step = learning_rate * (1 - t / n_epochs)
            unbiased = block.first / (1 - 0.5 ** (t + 1)), block.second / (1 - 0.9 ** (t + 1))
            block.at += step * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-7)

    for turn, rounds in layout.supersteps(n_epochs, UMAP_INNER):
        layout.advance(move, turn, rounds)
    return layout.result()


def place_by_neighbours(
    vectors: DataFrame,
    model: DataFrame,
    layout: DataFrame,
    n_neighbors: int = 15,
    min_dist: float = 0.01,
    metric: str = "euclidean",
    n_epochs: int = 100,
    negative_sample_rate: int = 5,
    learning_rate: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Place every cell in a fitted layout.

    A cell starts at the weighted mean of its nearest model cells and is then
    moved against the frozen layout; cells do not see each other, so batches are
    independent. The positions of the neighbours come by a join, the far cells are
    a fixed number of hashed model cells. Model cells keep their fitted position.
    """
    others = vectors.join(model.select("cell_idx"), "cell_idx", "left_anti")
    knn = nearest(others, model, n_neighbors, metric)
    far = layout.orderBy(F.xxhash64("cell_idx", F.lit(seed)), "cell_idx").limit(DRAWS).select("vec").toArrow()
    drawn = layout.sparkSession.sparkContext.broadcast(list_matrix(far.column("vec")))
    a, b = curve_parameters(min_dist)
    pull = umap_pull(a, b)
    rounds = max(1, n_epochs // 3)
    weighted = weighted_neighbours(knn, fuzzy_weights, n_neighbors)
    links = weighted.select("cell_idx", F.posexplode(F.arrays_zip("nn", "weight")).alias("pos", "z"))
    near = links.join(layout.select(F.col("cell_idx").alias("n"), "vec"), F.col("z.nn") == F.col("n"))
    listed = near.groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("z.weight").alias("weight"), "vec"))).alias("l"))
    rows = listed.select("cell_idx", F.col("l.weight").alias("weight"), F.flatten("l.vec").alias("near"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = drawn.value
        for batch in batches:
            if not batch.num_rows:
                continue
            w = list_matrix(batch.column("weight"))
            k = w.shape[1]
            near_at = list_matrix(batch.column("near")).reshape(len(w) * k, -1)
            node = np.repeat(np.arange(len(w)), k)
            sums = lambda v: np.stack([np.bincount(node, x, len(w)) for x in v.T], axis=1)  # noqa: B023,E731
            strength = w.sum(axis=1, keepdims=True)
            mine = sums(near_at * w.reshape(-1, 1)) / np.maximum(strength, 1e-12)
            ids = batch.column("cell_idx").to_numpy().astype(np.uint64)
            for turn in range(rounds):
                picks = mixed(seed, 3, turn, ids[:, None], np.arange(2 * negative_sample_rate)[None, :]) % np.uint64(len(pool))
                push = umap_push(mine, pool[picks.astype(np.int64)], a, b)
                move = sums(pull(mine[node] - near_at, w.ravel())) + negative_sample_rate * strength * push
                mine = mine + 0.1 * learning_rate * (1 - turn / rounds) * np.clip(move, -1, 1)
            yield pa.RecordBatch.from_arrays([batch.column("cell_idx"), matrix_list(mine)], ["cell_idx", "vec"])

    return rows.mapInArrow(place, "cell_idx long, vec array<double>").unionByName(layout)


def tsne_pull(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    return diff * (w / (1 + (diff**2).sum(axis=1)))[:, None]


def tsne_sums(block: Block) -> np.ndarray:
    """``block.sums`` of ``tsne_pull`` along the links, a coordinate at a time."""
    diff = [mine[block.node] - around[block.other] for mine, around in zip(block.at.T.copy(), block.around().T.copy())]
    share = block.weight / (1 + sum(d * d for d in diff))
    return np.stack([np.bincount(block.node, d * share, len(block.at)) for d in diff], axis=1).astype(float)


def fit_tsne(vectors: DataFrame, components: int = 2, max_iter: int = 500, seed: int = 0, block_size: int = BLOCK) -> DataFrame:
    """``(cell_idx, vec)``: t-SNE of all cells given.

    Attraction runs along the sparse neighbour probabilities. Repulsion is read from a
    grid: with one block from the live positions of every round; with several from the
    field of all cells at the start of a superstep, in which a block replaces its own part.
    """
    if components != 2:
        raise ValueError("t-SNE layouts have two dimensions")
    vectors = materialize(vectors.select("cell_idx", "vec"), "tsne")
    n = vectors.count()
    layout = Layout(starting_positions(vectors, 2, 1e-4, seed), tsne_links(vectors, n), 2, tsne_pull, seed=seed, block_size=block_size)
    rate, early = max(n / 12.0 / 4, 50.0), max_iter // 4

    def move(block: Block, turn: int, rounds: int, field: dict | None) -> None:
        # ``first`` is the velocity, ``second`` the logarithm of the gain
        fixed, others = block.at.copy(), None
        if field is not None:
            others = Grid((field["low_x"], field["low_y"]), field["step"], field["intervals"])
            potentials = field["potentials"].reshape(4, -1)
        for t in range(turn, turn + rounds):
            low, high = block.at.min(axis=0), block.at.max(axis=0)
            if field is None:
                own = Grid.over(low, high)
                nodes = own.nodes(block.at)
                read = own.read(own.potentials(own.spread(block.at, charges(block.at), nodes)), block.at, nodes)
                z = read[:, 0].sum() - len(block.at)
            else:
                own = Grid.over(np.minimum(low, fixed.min(axis=0)), np.maximum(high, fixed.max(axis=0)))
                nodes = own.nodes(block.at)
                change = own.spread(block.at, charges(block.at), nodes) - own.spread(fixed, charges(fixed))
                read = own.read(own.potentials(change), block.at, nodes) + others.read(potentials, block.at)
                z = field["z"] - n
            pull = tsne_sums(block) + block.steady[:, :-1]
            grad = 4 * ((12.0 if t < early else 1.0) * pull - repulsion(block.at, read) / max(z, 1e-12))
            gain = np.exp(block.second)
            gain = np.where(np.sign(grad) == np.sign(block.first), gain * 0.8, gain + 0.2).clip(0.01)
            block.second = np.log(gain)
            block.first = (0.5 if t < early else 0.8) * block.first - rate * gain * grad
            block.at += block.first
            if field is None:
                block.at -= block.at.mean(axis=0)

    for turn, rounds in layout.supersteps(max_iter, TSNE_INNER):
        field = None
        if layout.n_blocks > 1:  # wide enough for the way of a superstep
            field = field_of(layout, Grid.over(*extent(layout), spare=0.1, least=INTERVALS * INTERVAL))
        layout.advance(move, turn, rounds, field)
    return layout.result()


def project(knn: DataFrame, clusters: DataFrame, layout: DataFrame) -> DataFrame:
    """``(cell_idx, vec)``: mean position of a cell's neighbours that share its cluster.

    ``clusters(cell_idx, cluster_id)`` covers all cells, ``layout`` the sampled
    ones. Cells without a cluster, or in cluster 0, get no position.
    """
    known = clusters.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != 0)).select("cell_idx", "cluster_id")
    near = known.join(layout, "cell_idx").select(
        F.col("cell_idx").alias("nn_cell_idx"), F.col("cluster_id").alias("nn_cluster"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")
    )
    return (
        knn.join(near, "nn_cell_idx")
        .join(known, "cell_idx")
        .where(F.col("nn_cluster") == F.col("cluster_id"))
        .groupBy("cell_idx")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        .select("cell_idx", F.array("x", "y").alias("vec"))
    )


def embed_cells(exp: Experiment, embedding: str = "tsne", use_subsamples: bool = True, seed: int = 0, **options) -> Experiment:
    """Add a 2-D embedding under its name: fitted on the sampled cells, then projected."""
    name = embedding.lower()
    if name not in ("tsne", "umap"):
        raise ValueError(f"embedding {embedding} is not available")
    exp.require("norm")
    sampled = use_subsamples and "sampled" in exp.cells.columns
    if sampled:
        exp.require("knn", "cluster_id")
    cells = exp.cells.where("sampled") if sampled else exp.cells
    vectors = dense_vectors(exp.expr, cells, selected_genes(exp), log2p1("norm"))
    layout = fit_tsne(vectors, 2, seed=seed, **options) if name == "tsne" else fit_umap(vectors, 2, seed=seed, **options)
    if sampled:
        layout = project(exp.knn, exp.cells.select("cell_idx", "cluster_id"), layout)
    placed = materialize(layout, name)
    others = {k: v for k, v in exp.embeddings.items() if k != embedding}
    return exp.evolve("embed_cells", {"embedding": embedding, "seed": seed}, embeddings={**others, embedding: placed})
