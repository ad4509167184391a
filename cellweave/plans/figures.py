"""Data frames behind the figures; drawing is left to the caller's plotting library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.functions.orderstats import exact_quantiles
from cellweave.functions.palette import cluster_colors, heat_colors
from cellweave.model import Experiment
from cellweave.operators.markers import check_clusters, reduce_for_markers, top_markers
from cellweave.session import materialize

# Point size falls with the log of the number of points, label text
# is twice the point size but not below the minimum.
POINT_SLOPE, POINT_START, TEXT_MINIMUM = -0.58, 6.77, 3


def scatter_points(layout: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cell_idx, x, y, label)``; cells without position or label are left out."""
    return (
        layout.select("cell_idx", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
        .join(labels.select("cell_idx", "label"), "cell_idx")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("label").isNotNull())
    )


def label_centers(points: DataFrame) -> DataFrame:
    """``(label, x, y, n)``: median position per label of a written table of points."""
    x = exact_quantiles(points, "x", [0.5], ["label"]).select("label", F.col("q")[0].alias("x"))
    y = exact_quantiles(points, "y", [0.5], ["label"]).select("label", F.col("q")[0].alias("y"))
    n = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(x, "label").join(y, "label").select("label", "x", "y", "n")


def point_sizes(points: DataFrame) -> DataFrame:
    size = POINT_SLOPE * F.ln(F.count(F.lit(1))) + POINT_START
    return points.agg(F.count(F.lit(1)).alias("n_points"), size.alias("point_size")).withColumn(
        "text_size", F.greatest(F.col("point_size") * 2, F.lit(float(TEXT_MINIMUM)))
    )


def scatter_plot(exp: Experiment, labels: DataFrame | None = None, title: str = "") -> dict:
    """Points, label centres, sizes and colours of the latest embedding."""
    if not exp.embeddings:
        raise ValueError("no embedding found")
    if labels is None:
        exp.require("cluster_id")
        labels = exp.cells.select("cell_idx", F.col("cluster_id").alias("label"))
    elif labels.count() != exp.cells.count():
        raise ValueError("labels do not cover the cells")
    points = materialize(scatter_points(list(exp.embeddings.values())[-1], labels), "points")
    centers = label_centers(points)
    return {
        "points": points,
        "centers": centers,
        "sizes": point_sizes(points),
        "colors": cluster_colors(centers.count()),
        "title": title,
        "axes": ("DIM 1", "DIM 2"),
    }


def z_scores(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """``(gene_idx, cell_idx, value, z)`` of log2(norm + 1), one row per gene and cell.

    A heatmap shows every cell of every gene, so the zeros are written out; means
    and deviations come from the non-zeros alone. ``genes`` are a few chosen ones.
    """
    chosen = genes.select("gene_idx").distinct()
    seen = expr.join(chosen, "gene_idx").join(cells.select("cell_idx"), "cell_idx", "left_semi").select(
        "gene_idx", "cell_idx", log2p1("norm").alias("value")
    )
    n = cells.agg(F.count(F.lit(1))).scalar()
    stats = (
        seen.groupBy("gene_idx")
        .agg(F.count(F.lit(1)).alias("nnz"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
        .withColumn("n", n)
        .select(
            "gene_idx",
            (F.col("m") * F.col("nnz") / F.col("n")).alias("mean"),
            F.sqrt(
                (F.col("nnz") * F.col("v") + F.col("nnz") * (F.col("n") - F.col("nnz")) / F.col("n") * F.col("m") * F.col("m"))
                / (F.col("n") - 1)
            ).alias("sd"),
        )
    )
    listed = chosen.join(stats, "gene_idx", "left").agg(
        F.collect_list(F.struct("gene_idx", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"))).alias("l")
    ).scalar()
    grid = cells.select("cell_idx").withColumn("l", listed).select("cell_idx", F.explode("l").alias("g")).select("cell_idx", "g.*")
    return (
        grid.join(seen, ["cell_idx", "gene_idx"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .select("gene_idx", "cell_idx", "value", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    )


def label_positions(labels: DataFrame) -> DataFrame:
    """``(cluster_id, freq, upto, pos)``: column at which a cluster's name stands, the
    middle of its run of cells, half positions to even."""
    freq = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy(F.lit(0)).orderBy("cluster_id")  # one row per cluster
    upto = F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return freq.withColumn("upto", upto).withColumn("pos", F.bround((2 * F.col("upto") - F.col("freq")) / 2).cast("long"))


def heatmap(exp: Experiment, markers: DataFrame, selected_clusters: Sequence[int] | None = None, nDE: int = 10, sample_length: int | None = 100, seed: int = 0) -> dict:
    """Z-scores of the top markers over ``sample_length`` cells of every cluster, ``None`` for all."""
    expr, labels = reduce_for_markers(exp, sample_length, seed=seed)
    wanted = check_clusters(labels, selected_clusters)
    labels = labels.where(F.col("cluster_id").isin(wanted))
    genes = materialize(top_markers(markers, nDE).select("gene_idx").distinct(), "genes")
    cells = z_scores(expr, labels, genes).join(labels, "cell_idx").join(exp.genes.select("gene_idx", "symbol"), "gene_idx")
    return {"cells": cells, "labels": label_positions(labels), "colors": cluster_colors(len(wanted)), "heat": heat_colors()}


def violin_values(expr: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """``(gene_idx, cluster_id, cell_idx, value)`` of log2(norm + 1), zeros included."""
    return z_scores(expr, labels, genes).join(labels.select("cell_idx", "cluster_id"), "cell_idx").select(
        "gene_idx", "cluster_id", "cell_idx", "value"
    )


def violin_summary(expr: DataFrame, labels: DataFrame, genes: DataFrame, probs: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """``(gene_idx, cluster_id, n, q)``: quantiles with the zeros counted, not stored.

    Only non-zeros are grouped by value. The zeros are one more value, placed
    first, so no dense table is built.
    """
    seen = (
        expr.join(genes.select("gene_idx").distinct(), "gene_idx")
        .join(labels.select("cell_idx", "cluster_id"), "cell_idx")
        .groupBy("gene_idx", "cluster_id", log2p1("norm").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    listed = sizes.agg(F.collect_list(F.struct("cluster_id", "size")).alias("l")).scalar()
    every = (
        genes.select("gene_idx").distinct().withColumn("l", listed)
        .select("gene_idx", F.explode("l").alias("c")).select("gene_idx", "c.cluster_id", "c.size")
    )
    nonzero = seen.groupBy("gene_idx", "cluster_id").agg(F.sum("n").alias("nnz"))
    zeros = every.join(nonzero, ["gene_idx", "cluster_id"], "left").select(
        "gene_idx", "cluster_id", F.lit(0.0).alias("value"), (F.col("size") - F.coalesce("nnz", F.lit(0))).alias("n")
    )
    return weighted_quantiles(seen.unionByName(zeros.where("n > 0")), ["gene_idx", "cluster_id"], "value", probs)


def weighted_quantiles(freq: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles from value counts ``n``, for any number of groups."""
    from cellweave.functions.orderstats import running_counts

    by = list(by)
    counted = running_counts(freq, by, value)
    total = counted.groupBy(*by).agg(F.sum("n").alias("_total"))
    spread = counted.join(total, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value)))

    parts = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(float(p))
        parts += [at(F.floor(h)).alias(f"lo{i}"), at(F.floor(h) + 1).alias(f"hi{i}"), F.max(h - F.floor(h)).alias(f"f{i}")]
    grouped = spread.groupBy(*by).agg(F.max("_total").alias("n"), *parts)
    q = [F.col(f"lo{i}") + F.col(f"f{i}") * (F.coalesce(f"hi{i}", f"lo{i}") - F.col(f"lo{i}")) for i in range(len(probs))]
    return grouped.select(*by, "n", F.array(*q).alias("q"))


def marker_plot(exp: Experiment, gene_list: Sequence[str], sample_length: int | None = 100, seed: int = 0) -> dict:
    """Values and quantiles per gene and cluster for violins, three to a row."""
    expr, labels = reduce_for_markers(exp, sample_length, seed=seed)
    genes = materialize(exp.genes.where(F.col("symbol").isin(list(gene_list))).select("gene_idx", "symbol"), "genes")
    found = {r[0] for r in genes.select("symbol").collect()}
    missing = [g for g in gene_list if g not in found]
    if missing:
        raise ValueError(f"genes not found: {missing}")
    columns = min(3, len(gene_list))
    return {
        "values": violin_values(expr, labels, genes).join(genes, "gene_idx"),
        "summary": violin_summary(expr, labels, genes).join(genes, "gene_idx"),
        "colors": cluster_colors(labels.select("cluster_id").distinct().count()),
        "grid": (-(-len(gene_list) // 3), columns),
    }
