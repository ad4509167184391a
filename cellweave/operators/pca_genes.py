"""Gene selection from the loadings of the most multi-modal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.model import Experiment, update_column
from cellweave.operators.vectors import dense_vectors, gene_positions, list_matrix, matrix_list
from cellweave.session import materialize

# Components computed, components kept for the gene score, and the
# grid on which a component's score density is evaluated.
COMPONENTS = 50
BEST_COMPONENTS = 10
GRID = 512

# Sketch of the range of the cells: directions beyond the wanted components, and
# multiplications with the covariance. The driver holds genes x directions numbers.
OVERSAMPLE = 10
POWERS = 4
MAX_SKETCH = 512 * 2**20

MERGED_ROWS = 64  # triangular factors that one step of the merging tree takes
CHUNK = 256  # genes of one row of partial sums


def column_sums(vectors: DataFrame) -> tuple[int, np.ndarray, float]:
    """``(rows, sums of the columns, sum of all squares)``"""
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("sums"), F.sum(squares).alias("squares")
    ).first()
    if not row.n:
        raise ValueError("no cells to take components of")
    return row.n, np.array(row.sums), row.squares


def covariance_times(vectors: DataFrame, center: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """``X'(X W)`` of the centred cells, genes x directions.

    Every task multiplies its own batches; partial sums are added up in chunks of
    genes. A genes x genes matrix is never formed.
    """
    model = vectors.sparkSession.sparkContext.broadcast((center, directions))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, w = model.value
        total = np.zeros_like(w)
        for batch in batches:
            if batch.num_rows:
                x = list_matrix(batch.column("vec")) - middle
                total += x.T @ (x @ w)
        for lo in range(0, len(total), CHUNK):
            rows = total[lo:lo + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1, lo)), matrix_list(rows.reshape(1, -1))], ["i", "rows"])

    parts = vectors.select("vec").mapInArrow(partial, "i long, rows array<double>")
    added = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("rows"))).alias("rows")).orderBy("i").toArrow()
    return np.concatenate([np.array(r.as_py()).reshape(-1, directions.shape[1]) for r in added.column("rows")])


def triangular_factor(vectors: DataFrame, center: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """``R`` of a QR of the centred cells x directions sketch: one factor per task, merged in a tree."""
    width = directions.shape[1]
    model = vectors.sparkSession.sparkContext.broadcast((center, directions))

    def merged(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([matrix_list(r.reshape(1, -1))], ["r"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, w = model.value
        return merged((list_matrix(b.column("vec")) - middle) @ w for b in batches if b.num_rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(row.values.to_numpy().reshape(-1, width) for b in batches for row in b.column("r"))

    factors = materialize(vectors.select("vec").mapInArrow(sketch, "r array<double>"), "factors")
    n = factors.count()
    while n > MERGED_ROWS:
        factors = materialize(factors.repartition(-(-n // MERGED_ROWS)).mapInArrow(join, "r array<double>"), "factors")
        n = factors.count()
    held = [row.values.to_numpy().reshape(-1, width) for row in factors.toArrow().column("r").combine_chunks()]
    return np.linalg.qr(np.vstack(held), mode="r")


def range_directions(vectors: DataFrame, center: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Orthonormal genes x directions that hold the leading components.

    A random start and its products with powers of the covariance (a block Krylov space).
    If that many directions are as many as genes, all of them are taken and the result is exact.
    """
    width = len(center)
    block = min(k + OVERSAMPLE, width)
    powers = max(1, min(POWERS, MAX_SKETCH // (8 * width * block) - 1))
    if (powers + 1) * block >= width:
        return np.eye(width)
    last, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))
    basis = last
    for _ in range(powers):
        new = covariance_times(vectors, center, last)
        for _ in range(2):  # twice is enough for full precision
            new = new - basis @ (basis.T @ new)
        scale = np.linalg.norm(new, axis=0).max()
        if scale < 1e-10 * max(1.0, np.abs(center).max()):
            break
        last, _ = np.linalg.qr(new)
        basis = np.hstack([basis, last])
    return np.linalg.qr(basis)[0]


def principal_components(vectors: DataFrame, k: int):
    """``(scores(cell_idx, vec), loadings as a numpy genes x k array, variance shares)``.

    Centred, not scaled; a component's largest loading is positive. Components come from
    the triangular factor of the cells in the sketched directions.
    """
    n, sums, squares = column_sums(vectors)
    center = sums / n
    directions = range_directions(vectors, center, k)
    _, sizes, turned = np.linalg.svd(triangular_factor(vectors, center, directions), full_matrices=False)
    axes = (directions @ turned.T)[:, :k]
    variances = np.zeros(k)
    variances[: len(sizes[:k])] = sizes[:k] ** 2 / max(n - 1, 1)
    if axes.shape[1] < k:  # fewer cells than components
        axes = np.linalg.qr(np.hstack([axes, np.eye(len(center))]))[0][:, :k] if len(center) >= k else axes
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    total = max((squares - n * (center**2).sum()) / max(n - 1, 1), 0.0)
    model = vectors.sparkSession.sparkContext.broadcast((center, axes))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, rotation = model.value
        for batch in batches:
            if batch.num_rows:
                x = (list_matrix(batch.column("vec")) - middle) @ rotation
                yield pa.RecordBatch.from_arrays([batch.column("cell_idx"), matrix_list(x)], ["cell_idx", "vec"])

    scores = vectors.select("cell_idx", "vec").mapInArrow(rotate, "cell_idx long, vec array<double>")
    return scores, axes, variances / max(total, 1e-300)


def long_scores(scores: DataFrame) -> DataFrame:
    return scores.select("cell_idx", F.posexplode("vec").alias("pc", "score"))


def density_bins(long: DataFrame) -> DataFrame:
    """``(pc, bw, low, high, variance, bin, weight)`` of ``(pc, score)``: linearly binned scores on a grid.

    The bandwidth is the rule of thumb 0.9 min(sd, iqr / 1.34) n^(-1/5); the density is asked
    for from three bandwidths below the lowest score to three above the highest (``low``,
    ``high``), and binned on a grid that reaches four bandwidths further on both sides.
    Weights of a component add up to one; components without spread have no rows.
    """
    # Component scores exist for sampled cells only, so a component is a bounded group.
    spread = long.groupBy("pc").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("score").alias("sd"),
        F.var_samp("score").alias("variance"),
        F.min("score").alias("lowest"),
        F.max("score").alias("highest"),
        F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).alias("quartiles"),
    )
    iqr = (F.col("quartiles")[1] - F.col("quartiles")[0]) / 1.34
    narrow = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    spread = (
        spread.withColumn("bw", 0.9 * narrow * F.pow("n", F.lit(-0.2)))
        .where("bw > 0")
        .withColumn("low", F.col("lowest") - 3 * F.col("bw"))
        .withColumn("high", F.col("highest") + 3 * F.col("bw"))
    )
    step = (F.col("high") - F.col("low") + 8 * F.col("bw")) / (GRID - 1)
    place = long.join(F.broadcast(spread), "pc").withColumn("at", (F.col("score") - F.col("low") + 4 * F.col("bw")) / step)
    below = F.floor("at")
    halves = F.array(
        F.struct(below.alias("bin"), (1 - (F.col("at") - below)).alias("weight")),
        F.struct((below + 1).alias("bin"), (F.col("at") - below).alias("weight")),
    )
    keys = ["pc", "bw", "low", "high", "variance"]
    return (
        place.select(*keys, "n", F.explode(halves).alias("h"))
        .groupBy(*keys, "n", "h.bin")
        .agg((F.sum("h.weight") / F.col("n")).alias("weight"))
        .drop("n")
    )


def component_modality(scores: DataFrame) -> DataFrame:
    """``(pc, modality, variance)`` of the score distribution per component.

    Modality is half the number of runs of one sign of the slope of a Gaussian density
    estimate smoothed by a penalised cubic spline. Spark bins the scores; only the grid
    of one component (512 weights) reaches a task as a group.
    """
    return density_bins(long_scores(scores)).groupBy("pc").applyInPandas(_half_runs, "pc int, modality double, variance double")


def density_on_grid(weights: np.ndarray, bw: float, low: float, high: float) -> np.ndarray:
    """The density at ``GRID`` points from low to high: kernel sums on the wider grid, read off between its points."""
    wide = np.linspace(low - 4 * bw, high + 4 * bw, GRID)
    kernel = np.exp(-0.5 * ((wide - wide[0])[None, :] - (wide - wide[0])[:, None]) ** 2 / bw**2) / (bw * np.sqrt(2 * np.pi))
    return np.interp(np.linspace(low, high, GRID), wide, kernel @ weights)


#: Penalty of the squared second derivative on a grid of unit spacing. A smoothing parameter of 0.5 is 16 times the
#: ratio of the sums of squares of the spline basis (1/2) and of its second derivatives (8/3).
PENALTY = 3.0


def spline_slopes(values: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Slopes at the points of the natural cubic spline that minimises squared misfit plus penalty, unit spacing.

    With second derivatives ``c`` at the inner points, ``(R + penalty Q'Q) c = Q'y`` and the
    fit is ``y - penalty Q c``; the band matrix has five diagonals and is eliminated along them.
    """
    n = len(values)
    m = n - 2
    main = np.full(m, 2 / 3 + 6 * penalty)
    one = np.full(m, 1 / 6 - 4 * penalty)
    two = np.full(m, penalty)
    right = np.diff(values, 2)
    # factors of a symmetric band matrix: unit lower triangle with two bands, and a diagonal
    d, l1, l2, z = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
    for i in range(m):
        d[i] = main[i]
        z[i] = right[i]
        if i >= 2:
            l2[i] = two[i] / d[i - 2]
            d[i] -= l2[i] ** 2 * d[i - 2]
            z[i] -= l2[i] * z[i - 2]
        if i >= 1:
            l1[i] = (one[i] - (l2[i] * d[i - 2] * l1[i - 1] if i >= 2 else 0.0)) / d[i - 1]
            d[i] -= l1[i] ** 2 * d[i - 1]
            z[i] -= l1[i] * z[i - 1]
    c = z / d
    for i in range(m - 2, -1, -1):
        c[i] -= l1[i + 1] * c[i + 1] + (l2[i + 2] * c[i + 2] if i + 2 < m else 0.0)
    curve = np.concatenate([[0.0], c, [0.0]])
    fit = values.astype(float).copy()
    fit[:-2] -= penalty * c
    fit[1:-1] += 2 * penalty * c
    fit[2:] -= penalty * c
    step = np.diff(fit)
    slopes = np.empty(n)
    slopes[:-1] = step - (2 * curve[:-1] + curve[1:]) / 6
    slopes[-1] = step[-1] + (curve[-2] + 2 * curve[-1]) / 6
    return slopes


def half_runs(density: np.ndarray) -> float:
    return (1 + np.count_nonzero(np.diff(np.sign(spline_slopes(density))))) / 2


def _half_runs(grid: pd.DataFrame) -> pd.DataFrame:
    weights = np.zeros(GRID)
    np.add.at(weights, grid["bin"].astype(int).clip(0, GRID - 1), grid["weight"])
    bw, low, high, variance = (grid[c].iloc[0] for c in ("bw", "low", "high", "variance"))
    runs = half_runs(density_on_grid(weights, bw, low, high))
    return pd.DataFrame({"pc": [grid["pc"].iloc[0]], "modality": [runs], "variance": [variance]})


def best_components(modality: DataFrame, keep: int = BEST_COMPONENTS) -> DataFrame:
    return modality.orderBy(F.desc("modality"), F.desc("variance"), "pc").limit(keep)


def gene_scores(loadings: DataFrame, components: DataFrame) -> DataFrame:
    """``(gene_idx, score)``: the largest absolute loading over the chosen components."""
    return (
        loadings.join(F.broadcast(components.select("pc")), "pc")
        .groupBy("gene_idx")
        .agg(F.max(F.abs("loading")).alias("score"))
    )


def loading_table(genes: DataFrame, loadings: np.ndarray) -> DataFrame:
    """``(gene_idx, pc, loading)`` for the bounded gene selection of the components."""
    rows = pa.table({"pos": np.arange(len(loadings), dtype=np.int32), "row": matrix_list(loadings)})
    frame = genes.sparkSession.createDataFrame(rows)
    return (
        gene_positions(genes).join(frame, "pos").select("gene_idx", F.posexplode("row").alias("pc", "loading"))
    )


def top_component_genes(vectors: DataFrame, genes: DataFrame, top: int = 200, k: int = COMPONENTS) -> DataFrame:
    """``(gene_idx, score)`` of the ``top`` genes; ties go to the smaller gene."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    scores, loadings, _ = principal_components(vectors, max(1, min(k, n - 1, width)))
    chosen = best_components(component_modality(scores))
    scored = gene_scores(loading_table(genes, loadings), chosen)
    return scored.orderBy(F.desc("score"), "gene_idx").limit(top)


def rank_pca_genes(exp: Experiment, top: int = 200) -> Experiment:
    """Flag the ``top`` genes that shape the leading components of the sampled cells."""
    exp.require("norm", "hvg", "sampled")
    genes = exp.genes.where("hvg")
    vectors = materialize(dense_vectors(exp.expr, exp.cells.where("sampled"), genes, log2p1("norm")), "vectors")
    best = top_component_genes(vectors, genes, top).select("gene_idx", F.lit(True).alias("pca_gene"))
    return exp.evolve(
        "rank_pca_genes",
        {"top": top},
        genes=materialize(update_column(exp.genes, best, "gene_idx", {"pca_gene": False}), "genes"),
    )
