"""Median-total normalisation and log scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.functions.orderstats import exact_quantiles
from cellweave.model import Experiment
from cellweave.session import materialize


def cell_totals(expr: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total count per cell, zero for empty cells."""
    sums = expr.groupBy("cell_idx").agg(F.sum("count").alias("total"))
    return cells.select("cell_idx", *by).join(sums, "cell_idx", "left").na.fill(0.0, ["total"])


def normalized(expr: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``norm = count / (total / median total)``, the median per batch with ``by``.

    The median covers every cell, also empty ones. The totals are written first:
    they feed the two median passes and the join, and are tiny beside the matrix.
    A cell with very many entries is split by the adaptive skew join.
    """
    totals = materialize(cell_totals(expr, cells, by), "totals")
    medians = exact_quantiles(totals, "total", [0.5], by)
    if by:
        factors = totals.join(F.broadcast(medians), list(by))  # one row per batch
        factor = F.col("total") / F.col("q")[0]
    else:
        factors, factor = totals, F.col("total") / medians.scalar()[0]
    factors = factors.where(F.col("total") != 0).select("cell_idx", factor.alias("_factor"))
    return expr.join(factors, "cell_idx").withColumn("norm", F.col("count") / F.col("_factor")).drop("_factor")


def normalize_counts(exp: Experiment, return_log: bool = False) -> Experiment:
    """Store ``norm`` and, on request, ``log = log2(norm + 1)`` beside the counts."""
    expr = normalized(exp.expr.drop("norm", "log"), exp.cells)
    if return_log:
        expr = expr.withColumn("log", log2p1("norm"))
    return exp.evolve("normalize_counts", {"return_log": return_log}, expr=materialize(expr, "expr"))
