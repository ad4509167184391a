"""Ranking of highly variable genes by dispersion within expression bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import ratio
from cellweave.functions.orderstats import exact_quantiles
from cellweave.model import Experiment, update_column
from cellweave.session import materialize

# Bin edges are the 10 % to 100 % quantiles in steps of 5 %; the
# factor makes the median absolute deviation consistent with a normal sd.
BIN_PROBS = [p / 100 for p in range(10, 101, 5)]
MAD_FACTOR = 1.4826


def gene_moments(
    expr: DataFrame, genes: DataFrame, cells: DataFrame, value: str = "norm", by: Sequence[str] = ()
) -> DataFrame:
    """Mean, sample variance and dispersion (variance / mean) over all cells.

    One pass over the non-zeros: Spark merges their mean and squared deviations
    stably, and the absent zeros enter as one more block with mean zero.
    """
    key = [*by, "gene_idx"]
    seen = expr.groupBy(*key).agg(
        F.count(value).alias("nnz"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    full = genes.select(*key).join(seen, key, "left")
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if by:
        full = full.join(F.broadcast(sizes), list(by))  # one row per batch
    else:
        full = full.withColumn("n", sizes.scalar())
    nnz, n, m = F.col("nnz"), F.col("n"), F.col("m")
    spread = nnz * F.col("v") + nnz * (n - nnz) / n * m * m
    return full.select(
        *key,
        F.coalesce(nnz, F.lit(0)).alias("nnz"),
        F.coalesce(m * nnz / n, F.lit(0.0)).alias("mean"),
        F.coalesce(F.try_divide(spread, n - 1), F.lit(0.0)).alias("variance"),
    ).withColumn("dispersion", ratio(F.col("variance"), F.col("mean")))


def expression_bins(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``bin``: right-closed intervals between quantiles of the gene means."""
    edges = exact_quantiles(moments, "mean", BIN_PROBS, by)
    if by:
        placed = moments.join(F.broadcast(edges.withColumnRenamed("q", "_edges")), list(by))  # one row per batch
    else:
        placed = moments.withColumn("_edges", edges.scalar())
    below = sum((F.col("_edges")[i] < F.col("mean")).cast("int") for i in range(len(BIN_PROBS)))
    return placed.withColumn("bin", below + 1).drop("_edges")


def bin_spread(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median and scaled median absolute deviation of dispersion per bin.

    A bin with an undefined dispersion has undefined statistics.
    """
    key = [*by, "bin"]  # at most 20 bins per batch
    whole = binned.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("dispersion").alias("n_defined")
    )
    middle = exact_quantiles(binned, "dispersion", [0.5], key).select(*key, F.col("q")[0].alias("bin_median"))
    away = binned.join(F.broadcast(middle), key).withColumn(
        "away", F.abs(F.col("dispersion") - F.col("bin_median"))
    )
    mad = exact_quantiles(away, "away", [0.5], key).select(*key, (F.col("q")[0] * F.lit(MAD_FACTOR)).alias("bin_mad"))
    defined = F.col("n_defined") == F.col("n_genes")
    return (
        whole.join(middle, key, "left")
        .join(mad, key, "left")
        .select(
            *key,
            "n_genes",
            F.when(defined, F.col("bin_median")).alias("bin_median"),
            F.when(defined, F.col("bin_mad")).alias("bin_mad"),
        )
    )


def dispersion_scores(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``dispersion_norm = |dispersion - bin median| / bin MAD``."""
    binned = materialize(expression_bins(moments, by), "bins")
    return binned.join(F.broadcast(bin_spread(binned, by)), [*by, "bin"]).withColumn(
        "dispersion_norm", ratio(F.abs(F.col("dispersion") - F.col("bin_median")), F.col("bin_mad"))
    )


def flag_variable(scores: DataFrame, ngenes_keep: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """Add ``hvg``: score at least the ``ngenes_keep``-th largest, ties kept, NULL if undefined.

    With fewer scored genes than asked for, all scored genes are kept. Only the
    best scores of each partition are shuffled to find the cutoff.
    """
    known = scores.where(F.col("dispersion_norm").isNotNull()).select(*by, "dispersion_norm")
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("dispersion_norm"))
        best = known.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= ngenes_keep)
        cutoffs = best.groupBy(*by).agg(F.min("dispersion_norm").alias("_cutoff"))
        return scores.join(F.broadcast(cutoffs), list(by), "left").withColumn(
            "hvg", F.col("dispersion_norm") >= F.col("_cutoff")
        ).drop("_cutoff")
    best = known.orderBy(F.desc("dispersion_norm")).limit(ngenes_keep)
    return scores.withColumn("hvg", F.col("dispersion_norm") >= best.agg(F.min("dispersion_norm")).scalar())


def rank_genes(exp: Experiment, ngenes_keep: int = 1000) -> Experiment:
    """Score every gene and flag the most variable ones as ``hvg``."""
    exp.require("norm")
    moments = materialize(gene_moments(exp.expr, exp.genes, exp.cells), "moments")
    scores = materialize(dispersion_scores(moments), "scores")
    flagged = flag_variable(scores, ngenes_keep).select("gene_idx", "dispersion_norm", "hvg")
    return exp.evolve(
        "rank_genes",
        {"ngenes_keep": ngenes_keep},
        genes=materialize(update_column(exp.genes, flagged, "gene_idx"), "genes"),
    )
