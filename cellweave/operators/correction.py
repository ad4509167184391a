"""Batch correction: rank values over well separated genes, or mutual neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.functions.orderstats import midranks
from cellweave.model import Experiment
from cellweave.operators.embed import fit_umap, place_by_neighbours
from cellweave.operators.knn import mutual_pairs, nearest
from cellweave.operators.normalize import normalize_counts
from cellweave.operators.pca_genes import principal_components
from cellweave.operators.vectors import dense_vectors, gene_positions, list_matrix, matrix_list
from cellweave.session import materialize

# Smallest value that can be close to another, neighbours and
# dimensions of the mutual-neighbour method.
CLOSE_FLOOR = 0.001
MNN_NEIGHBOURS = 20
MNN_DIMENSIONS = 50
MNN_REACH = 3


def adjacent_pairs(values: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """``(g1, g2)``, ``g1 < g2``: genes that are neighbours in some cell's value order.

    ``values(cell_idx, pos, value)`` holds non-zeros at gene positions 0..n-1. A
    cell's order starts with its zeros by position, so zeros are reasoned about
    instead of stored: two zeros are neighbours if only non-zeros lie between
    them, and the last zero precedes the smallest non-zero.
    """
    in_cell = Window.partitionBy("cell_idx")
    by_value, by_pos = in_cell.orderBy("value", "pos"), in_cell.orderBy("pos")
    rows = values.select(
        "cell_idx", "pos", "value",
        F.lag("pos").over(by_value).alias("smaller"),
        F.lag("pos").over(by_pos).alias("before"),
        (F.col("pos") - F.row_number().over(by_pos)).alias("run"),
    )
    ranked = rows.where(F.col("smaller").isNotNull()).select(
        F.least("smaller", "pos").alias("g1"), F.greatest("smaller", "pos").alias("g2")
    )
    per_cell = rows.groupBy("cell_idx", "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.min(F.struct("value", "pos")).alias("least")
    )
    around = per_cell.where((F.col("start") > 0) & (F.col("end") < n_genes - 1)).select(
        (F.col("start") - 1).alias("g1"), (F.col("end") + 1).alias("g2")
    )
    edge = per_cell.groupBy("cell_idx").agg(
        F.max(F.when(F.col("end") == n_genes - 1, F.col("start"))).alias("tail"), F.min("least").alias("least")
    )
    last_zero = F.coalesce(F.col("tail"), F.lit(n_genes)) - 1
    boundary = edge.where(last_zero >= 0).select(
        F.least(last_zero, F.col("least.pos")).alias("g1"), F.greatest(last_zero, F.col("least.pos")).alias("g2")
    )
    # (g, g+1) are neighbouring zeros unless every cell has one of them.
    touched = rows.select(F.explode(F.array(
        F.struct(F.col("pos").alias("g"), F.lit(1).alias("n")),
        F.struct((F.col("pos") - 1).alias("g"), F.when(F.col("before") == F.col("pos") - 1, 0).otherwise(1).alias("n")),
    )).alias("t")).groupBy("t.g").agg(F.sum("t.n").alias("cells"))
    side_by_side = (
        values.sparkSession.range(n_genes - 1)
        .join(touched, F.col("id") == F.col("g"), "left")
        .where(F.coalesce("cells", F.lit(0)) < n_cells)
        .select(F.col("id").alias("g1"), (F.col("id") + 1).alias("g2"))
    )
    return ranked.unionByName(around).unionByName(boundary).unionByName(side_by_side).distinct()


def close_counts(vectors: DataFrame, close_th: float) -> DataFrame:
    """``(g1, g2, n_close)``: cells in which two genes' values are relatively close.

    Every task adds its cells up in one genes x genes table before anything is
    shuffled, as for a Gram matrix, so no pair is sent per cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column("vec"))
            if total is None:
                total = np.zeros((x.shape[1], x.shape[1]), dtype=np.int64)
            for g in range(x.shape[1] - 1):
                mine, other = x[:, g:g + 1], x[:, g + 1:]
                low = np.minimum(mine, other)
                gap = np.full_like(low, np.inf)
                np.divide(np.maximum(mine, other) - low, low, out=gap, where=low >= CLOSE_FLOOR)
                total[g, g + 1:] += (gap < close_th).sum(axis=0)
        if total is not None:
            g1, g2 = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g1.astype(np.int64)), pa.array(g2.astype(np.int64)), pa.array(total[g1, g2])], ["g1", "g2", "n"]
            )

    partial = vectors.select("vec").mapInArrow(count, "g1 long, g2 long, n long")
    return partial.groupBy("g1", "g2").agg(F.sum("n").alias("n_close"))


def close_gene_pairs(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, close_th: float, cells_th: float
) -> DataFrame:
    """``(gene1, gene2, n_close)``: neighbouring genes close in more than the given share of cells.

    ``expr(cell_idx, gene_idx, value)`` holds the non-zero log values of a bounded
    gene selection.
    """
    n_cells, n_genes = cells.count(), genes.count()
    positions = F.broadcast(gene_positions(genes))  # bounded: dense_vectors below checks the size
    vectors = dense_vectors(expr, cells, genes, F.col("value"))
    values = expr.join(positions, "gene_idx").select("cell_idx", "pos", "value")
    pairs = close_counts(vectors, close_th).where(F.col("n_close") > cells_th * n_cells)
    near = pairs.join(adjacent_pairs(values, n_cells, n_genes), ["g1", "g2"], "left_semi")
    first = gene_positions(genes).select(F.col("gene_idx").alias("gene1"), F.col("pos").alias("g1"))
    second = gene_positions(genes).select(F.col("gene_idx").alias("gene2"), F.col("pos").alias("g2"))
    return near.join(first, "g1").join(second, "g2").select("gene1", "gene2", "n_close")


def removable_genes(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """First genes of close pairs; with a ``limit`` the smallest so many.

    A gene only ever goes as the first of a pair, and its partners come later in
    the order, so no earlier removal can save it: the sequential walk over the
    pairs equals this set.
    """
    found = pairs.select(F.col("gene1").alias("gene_idx")).distinct()
    return found if limit is None else found.orderBy("gene_idx").limit(limit)


def reduce_genes(
    expr: DataFrame,
    cells: DataFrame,
    genes: DataFrame,
    close_th: float = 0.01,
    cells_th: float = 0.05,
    limit: int | None = None,
) -> DataFrame:
    """The genes that remain after thinning."""
    removed = removable_genes(close_gene_pairs(expr, cells, genes, close_th, cells_th), limit)
    return genes.join(removed, "gene_idx", "left_anti")


def rank_transform(expr: DataFrame, value: str = "value") -> DataFrame:
    """``(cell_idx, gene_idx, rank)``: average ranks of a cell's non-zero values; zeros stay absent."""
    ranks = midranks(expr.where(F.col(value) != 0), ["cell_idx"], value).select("cell_idx", value, "rank")
    return expr.join(ranks, ["cell_idx", value]).select("cell_idx", "gene_idx", "rank")


def cosine_scaled(vectors: DataFrame) -> DataFrame:
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    norm = F.sqrt(squares)
    return vectors.select("cell_idx", F.when(norm > 0, F.transform("vec", lambda x: x / norm)).otherwise(F.col("vec")).alias("vec"))


def center_along(vectors: DataFrame, direction: list[float]) -> DataFrame:
    """Take away the spread of a batch along one unit direction, keeping its mean there."""
    axis = F.array(*[F.lit(float(x)) for x in direction])
    dot = F.aggregate(F.zip_with("vec", axis, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    placed = materialize(vectors.select("cell_idx", "vec", dot.alias("_at")), "mnn")
    middle = placed.agg(F.avg("_at")).first()[0]
    move = F.lit(middle) - F.col("_at")
    return placed.withColumn("_move", move).select(
        "cell_idx", F.zip_with("vec", F.transform(axis, lambda x: x * F.col("_move")), lambda a, b: a + b).alias("vec")
    )


def pair_shifts(pairs: DataFrame, goal: DataFrame, moving: DataFrame) -> DataFrame:
    """``(cell_idx, shift)``: mean difference of a moving cell to its partners."""
    return (
        pairs.join(goal.select(F.col("cell_idx").alias("left_idx"), F.col("vec").alias("goal")), "left_idx")
        .join(moving.select(F.col("cell_idx").alias("right_idx"), "vec"), "right_idx")
        .select(F.col("right_idx").alias("cell_idx"), array_to_vector(F.zip_with("goal", "vec", lambda a, b: a - b)).alias("shift"))
        .groupBy("cell_idx")
        .agg(vector_to_array(Summarizer.mean(F.col("shift"))).alias("shift"))
    )


def mutual_neighbour_correction(vectors: DataFrame, batches: DataFrame, order: list[int], k: int = MNN_NEIGHBOURS) -> DataFrame:
    """``(cell_idx, vec)`` with every later batch moved onto the batches before it.

    Mutual nearest neighbours pair cells of the same kind. A paired cell is off by
    the mean difference to its partners; every cell of the batch moves by the
    distance-weighted mean of its nearest paired cells' differences.
    """
    tagged = vectors.join(batches.select("cell_idx", "batch"), "cell_idx")
    done = materialize(tagged.where(F.col("batch") == order[0]).select("cell_idx", "vec"), "mnn")
    for batch in order[1:]:
        moving = materialize(tagged.where(F.col("batch") == batch).select("cell_idx", "vec"), "mnn")
        pairs = materialize(mutual_pairs(done, moving, k, "euclidean").select("left_idx", "right_idx"), "mnn")
        shift = materialize(pair_shifts(pairs, done, moving), "mnn")
        mean = shift.agg(vector_to_array(Summarizer.mean(array_to_vector("shift")))).first()[0]
        if mean is None:
            raise ValueError(f"batch {batch} shares no mutual neighbours with the batches before it")
        length = float(np.linalg.norm(mean))
        if length > 0:
            # Pairs form where the batches face each other, so spread along the
            # batch direction would hide a part of the shift.
            direction = [x / length for x in mean]
            done = materialize(center_along(done, direction), "mnn")
            moving = materialize(center_along(moving, direction), "mnn")
            shift = materialize(pair_shifts(pairs, done, moving), "mnn")
        anchors = moving.join(shift.select("cell_idx"), "cell_idx", "left_semi")
        near = nearest(moving, anchors, k, "euclidean")
        middle = F.percentile("dist", F.lit(0.5)).over(Window.partitionBy("cell_idx"))  # k rows per cell
        reach = F.greatest(middle * MNN_REACH, F.lit(1e-8))
        tricube = F.pow(1 - F.pow(F.least(F.lit(1.0), F.col("dist") / reach), F.lit(3)), F.lit(3)) + 1e-12
        smooth = (
            near.withColumn("w", tricube)
            .join(shift.withColumnRenamed("cell_idx", "nn_cell_idx"), "nn_cell_idx")
            .groupBy("cell_idx")
            .agg(vector_to_array(Summarizer.mean(array_to_vector("shift"), F.col("w"))).alias("shift"))
        )
        moved = moving.join(smooth, "cell_idx").select("cell_idx", F.zip_with("vec", "shift", lambda a, b: a + b).alias("vec"))
        done = materialize(done.unionByName(moved), "mnn")
    return done


def reconstruct(corrected: DataFrame, loadings: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """``(cell_idx, gene_idx, value)`` from corrected dimensions and ``loadings(gene_idx, weights)``.

    Dense by nature, so name the genes wanted.
    """
    chosen = loadings if genes is None else loadings.join(genes.select("gene_idx"), "gene_idx", "left_semi")
    listed = chosen.agg(F.collect_list(F.struct("gene_idx", "weights")).alias("l")).scalar()
    opened = corrected.withColumn("l", listed).select("cell_idx", "vec", F.explode("l").alias("g"))
    dot = F.aggregate(F.zip_with("vec", "g.weights", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return opened.select("cell_idx", "g.gene_idx", dot.alias("value"))


def correct_batches(
    exp: Experiment,
    method: str = "default",
    close_th: float = 0.1,
    cells_th: float = 0.1,
    components: int = 2,
    d: int = MNN_DIMENSIONS,
    k: int = MNN_NEIGHBOURS,
    max_removed: int | None = None,
    seed: int = 0,
    **umap,
) -> Experiment:
    """Add the corrected dimensions ``CComponents``.

    ``default``: thin the marker genes, rank-transform every cell (``RankMat``)
    and embed the ranks; the embedding is fitted on the flagged sample and all
    others are placed by their neighbours, or on all cells where none are flagged.
    At most ``max_removed`` genes go in the thinning. ``fastmnn``: principal components of all
    genes, aligned by mutual nearest neighbours.
    """
    exp.require("batch")
    exp = normalize_counts(exp)
    params = {"method": method, "close_th": close_th, "cells_th": cells_th, "components": components, "seed": seed}
    logged = exp.expr.select("cell_idx", "gene_idx", log2p1("norm").alias("value"))
    if method == "fastmnn":
        vectors = materialize(cosine_scaled(dense_vectors(logged, exp.cells, exp.genes, F.col("value"))), "vectors")
        n_cells, n_genes = exp.cells.count(), exp.genes.count()
        scores, loadings, _ = principal_components(vectors, max(1, min(d, n_cells - 1, n_genes)))
        order = sorted(r[0] for r in exp.cells.select("batch").distinct().collect())
        corrected = mutual_neighbour_correction(materialize(scores, "scores"), exp.cells, order, k)
        rows = pa.table({"pos": np.arange(n_genes, dtype=np.int32), "weights": matrix_list(loadings)})
        frame = exp.spark.createDataFrame(rows)
        table = materialize(gene_positions(exp.genes).join(frame, "pos").select("gene_idx", "weights"), "loadings")
        return exp.evolve(
            "correct_batches", params,
            embeddings={**exp.embeddings, "CComponents": corrected},
            tables={**exp.tables, "loadings": table},
        )
    genes = exp.genes.where("common_de") if "common_de" in exp.genes.columns else exp.genes
    genes = materialize(genes.select("gene_idx"), "genes")
    chosen = materialize(logged.join(genes, "gene_idx", "left_semi"), "logged")
    kept = materialize(reduce_genes(chosen, exp.cells, genes, close_th, cells_th, max_removed), "kept")
    ranks = materialize(rank_transform(chosen.join(kept, "gene_idx", "left_semi")), "ranks")
    vectors = materialize(dense_vectors(ranks, exp.cells, kept, F.col("rank")), "vectors")
    if "sampled" in exp.cells.columns:
        model = materialize(vectors.join(exp.cells.where("sampled"), "cell_idx", "left_semi"), "model")
        layout = materialize(fit_umap(model, components, metric="cosine", seed=seed, **umap), "layout")
        placed = materialize(place_by_neighbours(vectors, model, layout, metric="cosine", seed=seed, **umap), "placed")
    else:
        placed = materialize(fit_umap(vectors, components, metric="cosine", seed=seed, **umap), "placed")
    return exp.evolve(
        "correct_batches", params,
        embeddings={**exp.embeddings, "CComponents": placed},
        tables={**exp.tables, "RankMat": ranks},
    )
