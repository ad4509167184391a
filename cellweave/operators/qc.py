"""Quality filters for cells and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.orderstats import exact_quantiles
from cellweave.model import Experiment
from cellweave.session import materialize


def cell_support(expr: DataFrame, cells: DataFrame, min_count: float = 3, by: Sequence[str] = ()) -> DataFrame:
    """Genes with ``count >= min_count`` per cell, zero for empty cells."""
    hits = (
        expr.where(F.col("count") >= min_count)
        .groupBy("cell_idx")
        .agg(F.count(F.lit(1)).alias("n_genes"))
    )
    return cells.select("cell_idx", *by).join(hits, "cell_idx", "left").na.fill(0, ["n_genes"])


def good_cells(
    expr: DataFrame,
    cells: DataFrame,
    min_count: float = 3,
    ql_th: float = 0.001,
    qh_th: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cells whose support lies within two quantiles of all cells, bounds included."""
    if qh_th < ql_th:
        raise ValueError("lower limit must not exceed upper limit")
    support = materialize(cell_support(expr, cells, min_count, by), "support")
    bounds = exact_quantiles(support, "n_genes", [ql_th, qh_th], by)
    if by:
        support = support.join(F.broadcast(bounds), list(by))  # one row per batch
        q = F.col("q")
    else:
        q = bounds.scalar()
    return support.where((F.col("n_genes") >= q[0]) & (F.col("n_genes") <= q[1])).select("cell_idx", *by, "n_genes")


def gene_support(expr: DataFrame, genes: DataFrame, min_count: float = 2, by: Sequence[str] = ()) -> DataFrame:
    """Cells with ``count > min_count`` per gene, zero for unseen genes."""
    key = [*by, "gene_idx"]
    hits = expr.where(F.col("count") > min_count).groupBy(*key).agg(F.count(F.lit(1)).alias("n_cells"))
    return genes.select(*key).join(hits, key, "left").na.fill(0, ["n_cells"])


def good_genes(
    expr: DataFrame, genes: DataFrame, min_count: float = 2, min_cell: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """Genes seen (strictly) above ``min_count`` in more than ``min_cell`` cells."""
    return gene_support(expr, genes, min_count, by).where(F.col("n_cells") > min_cell)


def filter_cells(exp: Experiment, min_count: float = 3, ql_th: float = 0.001, qh_th: float = 1.0) -> Experiment:
    """Keep cells whose number of expressed genes lies within the quantile range."""
    keep = good_cells(exp.expr, exp.cells, min_count, ql_th, qh_th).select("cell_idx")
    return exp.evolve(
        "filter_cells",
        {"min_count": min_count, "ql_th": ql_th, "qh_th": qh_th},
        expr=exp.expr.join(keep, "cell_idx", "left_semi"),
        cells=exp.cells.join(keep, "cell_idx", "left_semi"),
    )


def filter_genes(exp: Experiment, min_count: float = 2, min_cell: int = 3) -> Experiment:
    """Keep genes expressed above ``min_count`` in more than ``min_cell`` cells."""
    keep = good_genes(exp.expr, exp.genes, min_count, min_cell).select("gene_idx")
    return exp.evolve(
        "filter_genes",
        {"min_count": min_count, "min_cell": min_cell},
        expr=exp.expr.join(keep, "gene_idx", "left_semi"),
        genes=exp.genes.join(keep, "gene_idx", "left_semi"),
    )
