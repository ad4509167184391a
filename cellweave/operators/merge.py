"""Joining batches on a shared set of informative genes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.model import Experiment, update_column
from cellweave.operators.cluster import cluster_cells
from cellweave.operators.hvg import dispersion_scores, flag_variable, gene_moments
from cellweave.operators.markers import find_markers, top_markers
from cellweave.operators.normalize import normalized
from cellweave.operators.pca_genes import rank_pca_genes
from cellweave.operators.qc import good_cells, good_genes
from cellweave.operators.sampling import sample_cells
from cellweave.session import materialize

# Per-batch settings of the merge.
GENE_FILTER = {"min_count": 1, "min_cell": 1}
HVG_KEEP = 1000
BATCH_CONF = 0.1
BATCH_MARKERS = {"lfc_th": 1, "q_th": 0.001, "nDE": 20}
DROPPED_CELL_COLUMNS = ("cluster_id", "sample_cluster_id")
DERIVED_GENE_COLUMNS = ("dispersion_norm", "hvg", "pca_gene", "common_de")

# Batch b's cells keep their index plus b times this stride, so keys stay unique
# without renumbering.
CELL_STRIDE = 1 << 44


def gene_presence(batch_expr: DataFrame) -> DataFrame:
    """``(gene_idx, n_batches, n_cells)`` for ``expr`` with a ``batch`` column."""
    per_batch = batch_expr.groupBy("gene_idx", "batch").agg(F.count(F.lit(1)).alias("n"))
    return per_batch.groupBy("gene_idx").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_cells"))


def common_genes(batch_genes: DataFrame, n_batches: int, key: str = "gene_idx") -> DataFrame:
    """Genes kept in every batch and variable in at least one.

    ``batch_genes`` has one row per batch and kept gene with its ``hvg`` flag.
    """
    return (
        batch_genes.groupBy(key)
        .agg(F.countDistinct("batch").alias("n_batches"), F.max(F.coalesce("hvg", F.lit(False))).alias("any_hvg"))
        .where((F.col("n_batches") == n_batches) & F.col("any_hvg"))
        .select(key)
    )


def prepare_batches(expr: DataFrame, cells: DataFrame, genes: DataFrame, ngenes_keep: int = HVG_KEEP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filter, normalise and rank genes of all batches in one plan.

    All three tables carry ``batch``; statistics are grouped by it, so the number
    of jobs does not grow with the number of batches.
    """
    by = ["batch"]
    keep_cells = materialize(good_cells(expr, cells, by=by).select("cell_idx"), "kept")
    cells = cells.join(keep_cells, "cell_idx", "left_semi")
    expr = materialize(expr.join(keep_cells, "cell_idx", "left_semi"), "expr")
    keep_genes = materialize(good_genes(expr, genes, by=by, **GENE_FILTER).select("batch", "gene_idx"), "kept")
    genes = genes.join(keep_genes, ["batch", "gene_idx"], "left_semi")
    expr = materialize(normalized(expr.join(keep_genes, ["batch", "gene_idx"], "left_semi"), cells, by), "expr")
    moments = materialize(gene_moments(expr, genes, cells, by=by), "moments")
    scores = flag_variable(materialize(dispersion_scores(moments, by), "scores"), ngenes_keep, by)
    genes = genes.join(scores.select("batch", "gene_idx", "dispersion_norm", "hvg"), ["batch", "gene_idx"])
    return expr, materialize(cells, "cells"), materialize(genes, "genes")


def stack(objects: Sequence[Experiment]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(expr, cells, genes)`` of all batches with ``batch`` = 1, 2, ... and unique cell keys.

    Gene keys stay those of their batch; columns that not every batch has are left out.
    """
    def shared(tables: list[DataFrame]) -> list[str]:
        return [c for c in tables[0].columns if c != "batch" and all(c in t.columns for t in tables)]

    cell_columns = shared([e.cells for e in objects])
    gene_columns = shared([e.genes for e in objects])
    exprs, cells, genes = [], [], []
    free = 0  # below the first key that no earlier batch uses, whatever strides its own keys have
    for i, exp in enumerate(objects, 1):
        batch = F.lit(i).alias("batch")
        low, high = exp.cells.agg(F.min("cell_idx"), F.max("cell_idx")).first()
        low, high = low or 0, high or 0
        shift = (F.col("cell_idx") + F.lit(free - low)).alias("cell_idx")
        free += high - low + 1
        exprs.append(exp.expr.select(batch, shift, "gene_idx", "count"))
        cells.append(exp.cells.select(batch, shift, *[c for c in cell_columns if c != "cell_idx"]))
        genes.append(exp.genes.select(batch, *gene_columns))
    return tuple(reduce(DataFrame.unionByName, tables) for tables in (exprs, cells, genes))


def batch_markers(expr: DataFrame, cells: DataFrame, genes: DataFrame, n_batches: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(gene ids, sampled flags)``: markers of the clusters of every batch.

    Only the model fits on the bounded samples go batch by batch.
    """
    found, flags = [], []
    for i in range(1, n_batches + 1):
        mine = F.col("batch") == i
        exp = Experiment(expr.where(mine).drop("batch"), cells.where(mine), genes.where(mine).drop("batch"))
        exp = rank_pca_genes(sample_cells(exp, seed=seed))
        exp = cluster_cells(exp, method="default", conf=BATCH_CONF, seed=seed)
        _, markers = find_markers(exp, seed=seed, **BATCH_MARKERS)
        top = top_markers(markers, BATCH_MARKERS["nDE"]).select("gene_idx")
        found.append(exp.genes.join(top, "gene_idx", "left_semi").select("gene_id"))
        flags.append(exp.cells.select("cell_idx", "sampled"))
    return reduce(DataFrame.unionByName, found).distinct(), reduce(DataFrame.unionByName, flags)


def merge_experiments(objects: Sequence[Experiment], use_de_genes: bool = True, seed: int = 0) -> Experiment:
    """One experiment over all batches with ``cells.batch`` = 1, 2, ...

    Every batch is filtered, normalised and ranked by its own statistics. Raw
    counts of the common genes are stacked; genes are matched by ``gene_id``. With
    ``use_de_genes`` the markers of every batch's clusters are flagged as
    ``genes.common_de``.
    """
    if len(objects) < 2:
        raise ValueError("merging needs at least two experiments")
    for exp in objects:
        if "gene_id" not in exp.genes.columns:
            raise ValueError("genes need a gene_id")
    expr, cells, batch_genes = stack(objects)
    dropped = [c for c in (*DERIVED_GENE_COLUMNS,) if c in batch_genes.columns]
    expr, cells, batch_genes = prepare_batches(expr, cells.drop(*DROPPED_CELL_COLUMNS), batch_genes.drop(*dropped))
    shared = materialize(common_genes(batch_genes, len(objects), "gene_id"), "common")
    genes = batch_genes.where(F.col("batch") == 1).drop("batch").join(shared, "gene_id", "left_semi")
    if use_de_genes:
        markers, flags = batch_markers(expr, cells, batch_genes, len(objects), seed)
        genes = update_column(genes, markers.withColumn("common_de", F.lit(True)), "gene_id", {"common_de": False})
        cells = update_column(cells, flags, "cell_idx")
    genes = materialize(genes, "genes")
    # Every batch's gene key maps to that of batch 1; one row per batch and common gene.
    target = batch_genes.select("batch", "gene_idx", "gene_id").join(
        genes.select("gene_id", F.col("gene_idx").alias("_gene")), "gene_id"
    )
    counts = expr.join(target.select("batch", "gene_idx", "_gene"), ["batch", "gene_idx"]).select(
        "cell_idx", F.col("_gene").alias("gene_idx"), "count"
    )
    merged = Experiment(expr=materialize(counts, "expr"), cells=materialize(cells, "cells"), genes=genes)
    return merged.evolve("merge_experiments", {"use_de_genes": use_de_genes, "batches": len(objects)})
