"""One-against-rest differential expression for all clusters in one plan.

Ranks are taken once per gene over the non-zero values; zeros form one tied block
below them. Rank sums, means and tie terms of every cluster come from the same
grouped counts, and the rest of the cells is always total minus cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import erfc_sql, ratio
from cellweave.functions.orderstats import bh_adjust, running_counts
from cellweave.model import Experiment
from cellweave.operators.sampling import stratified_sample
from cellweave.session import materialize

# Both groups below this size and no ties ask for the exact test.
EXACT_BELOW = 50


def rank_statistics(expr: DataFrame, labels: DataFrame, value: str = "norm", split_rows: int | None = None) -> DataFrame:
    """Per gene and cluster: sizes, sums, Mann-Whitney ``u`` and the tie sum.

    ``labels(cell_idx, cluster_id)`` names the cells of the test. Every gene with
    a non-zero value among them appears once for every cluster.
    """
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_a"))
    # One row per cluster, opened for every gene below.
    roster = sizes.agg(F.sum("n_a").alias("n"), F.collect_list(F.struct("cluster_id", "n_a")).alias("clusters"))
    folded = (
        expr.select("cell_idx", "gene_idx", F.col(value).alias("value"))
        .where(F.col("value") != 0)
        .join(labels, "cell_idx")
        .groupBy("gene_idx", "value", "cluster_id")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("gene_idx", "value")
        .agg(F.sum("c").alias("n"), F.collect_list(F.struct("cluster_id", "c")).alias("shares"))
    )
    ranked = running_counts(folded, ["gene_idx"], "value", split_rows=split_rows)
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    opened = ranked.select(
        "gene_idx", "value", rank.alias("rank"), F.explode("shares").alias("s"),
        # the tie term of a value is counted with its first share only
        (F.pow("n", F.lit(3)) - F.col("n")).alias("t"), F.col("shares")[0]["cluster_id"].alias("first"),
    )
    per_cluster = opened.groupBy("gene_idx", F.col("s.cluster_id").alias("cluster_id")).agg(
        F.sum("s.c").alias("nnz"),
        F.sum(F.col("rank") * F.col("s.c")).alias("rank_sum"),
        F.sum(F.col("value") * F.col("s.c")).alias("total"),
        F.sum(F.when(F.col("first") == F.col("s.cluster_id"), F.col("t")).otherwise(0.0)).alias("t"),
    )
    per_gene = per_cluster.groupBy("gene_idx").agg(
        F.sum("nnz").alias("nnz_all"),
        F.sum("total").alias("total_all"),
        F.sum("t").alias("t_all"),
        F.map_from_entries(
            F.collect_list(F.struct("cluster_id", F.struct("nnz", "rank_sum", "total")))
        ).alias("seen"),
    )
    full = (
        per_gene.withColumn("roster", roster.select(F.struct("n", "clusters")).scalar())
        .select("*", F.col("roster.n").alias("n_all"), F.explode("roster.clusters").alias("k"))
        .select("*", F.col("k.cluster_id").alias("cluster_id"), F.col("k.n_a").alias("n_a"))
        .withColumn("mine", F.try_element_at("seen", F.col("cluster_id")))
    )
    zeros = F.col("n_all") - F.col("nnz_all")
    nnz_a = F.coalesce(F.col("mine.nnz"), F.lit(0))
    n_b = F.col("n_all") - F.col("n_a")
    total_a = F.coalesce(F.col("mine.total"), F.lit(0.0))
    # zeros share the lowest ranks; every non-zero rank moves up by their number
    rank_sum = (
        F.coalesce(F.col("mine.rank_sum"), F.lit(0.0)) + nnz_a * zeros + (F.col("n_a") - nnz_a) * (zeros + 1) / 2.0
    )
    total_b = F.when(F.col("nnz_all") == nnz_a, F.lit(0.0)).otherwise(F.col("total_all") - total_a)
    return full.select(
        "gene_idx",
        "cluster_id",
        "n_a",
        n_b.alias("n_b"),
        F.try_divide(total_a, F.col("n_a")).alias("mean_a"),
        F.try_divide(total_b, n_b).alias("mean_b"),
        (rank_sum - F.col("n_a") * (F.col("n_a") + 1) / 2.0).alias("u"),
        (F.col("t_all") + F.pow(zeros, F.lit(3)) - zeros).alias("ties"),
    )


def with_fold_change(stats: DataFrame) -> DataFrame:
    """Add ``lfc = log2(mean_a / mean_b)``: x/0 gives Infinity, 0/x -Infinity, 0/0 NULL."""
    r = ratio(F.col("mean_a"), F.col("mean_b"))
    return stats.withColumn("lfc", F.when(r > 0, F.log2(r)).when(r == 0, F.lit(float("-inf"))))


def with_z(stats: DataFrame) -> DataFrame:
    """Add ``z`` with tie and continuity correction; NULL without any spread."""
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    sigma = F.sqrt(F.greatest(F.lit(0.0), a * b / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))))
    away = F.col("u") - a * b / 2.0
    return stats.withColumn("z", F.try_divide(away - F.signum(away) * 0.5, sigma))


def with_pvalue(stats: DataFrame) -> DataFrame:
    """Add the two-sided normal ``pvalue``, computed inside generated code."""
    tail = F.expr(erfc_sql("_x"))
    return stats.withColumn("_x", F.abs("z") / math.sqrt(2.0)).withColumn("pvalue", F.least(F.lit(1.0), tail)).drop("_x")


def with_exact_pvalue(stats: DataFrame) -> DataFrame:
    """Replace ``pvalue`` by the exact two-sided test where both groups are small and untied.

    Only meaningful for fewer than 100 cells in all, so at most 50 x 50 states each.
    """

    @F.pandas_udf("double")
    def exact(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        tables: dict = {}
        out = []
        for w, a, b in zip(u, n_a, n_b):
            if (a, b) not in tables:
                tables[a, b] = _rank_sum_cdf(int(a), int(b))
            cdf = tables[a, b]
            low, high = cdf[int(w)], 1.0 - (cdf[int(w) - 1] if w >= 1 else 0.0)
            out.append(min(1.0, 2 * (high if w > a * b / 2 else low)))
        return pd.Series(out)

    small = (F.col("ties") == 0) & (F.col("n_a") < EXACT_BELOW) & (F.col("n_b") < EXACT_BELOW)
    chosen = stats.where(small).withColumn("pvalue", exact("u", "n_a", "n_b"))
    return stats.where(~small).unionByName(chosen)


def _rank_sum_cdf(a: int, b: int) -> list[float]:
    """Distribution function of the Mann-Whitney statistic by counting arrangements."""
    import numpy as np

    ways = np.zeros((a + 1, a * b + 1))
    ways[0, 0] = 1
    for j in range(1, a + b + 1):  # the observation of overall rank j joins group a or not
        for i in range(min(a, j), 0, -1):
            shift = j - i
            if shift <= b:
                ways[i, shift:] += ways[i - 1, : ways.shape[1] - shift]
    return list(np.cumsum(ways[a]) / math.comb(a + b, a))


def significant(stats: DataFrame, lfc_th: float, q_th: float) -> DataFrame:
    """Up-regulated genes above the fold-change and below the adjusted p threshold."""
    return stats.where((F.col("lfc") > 0) & (F.abs("lfc") >= lfc_th) & (F.col("qvalue") <= q_th))


def top_markers(found: DataFrame, n: int = 30) -> DataFrame:
    """First ``n`` per cluster by adjusted p, then the smaller fold change, then the gene.

    Spark keeps the n best of each cluster in every partition before the shuffle.
    """
    order = Window.partitionBy("cluster_id").orderBy("qvalue", F.abs("lfc"), "gene_idx")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def markers_wide(top: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """One column of symbols per cluster, shorter ones padded with empty strings."""
    wide = top.groupBy("rn").pivot("cluster_id", list(clusters)).agg(F.first("symbol"))
    named = wide.select("rn", *[F.col(f"`{c}`").alias(f"cluster_{c}") for c in clusters])
    return named.na.fill("").orderBy("rn")


def test_markers(expr: DataFrame, labels: DataFrame, split_rows: int | None = None) -> DataFrame:
    """All genes x clusters with ``u, z, pvalue, qvalue, lfc``."""
    stats = with_pvalue(with_z(with_fold_change(rank_statistics(expr, labels, split_rows=split_rows))))
    if labels.count() < 2 * EXACT_BELOW:
        stats = with_exact_pvalue(stats)
    return bh_adjust(materialize(stats, "tests"), ["cluster_id"], "pvalue", split_rows=split_rows)


def reduce_for_markers(exp: Experiment, sample_length: int | None = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(expr, labels)`` restricted to at most ``sample_length`` cells per cluster."""
    exp.require("norm", "cluster_id")
    labels = materialize(stratified_sample(exp.cells.select("cell_idx", "cluster_id"), sample_length, seed), "labels")
    return exp.expr.join(labels.select("cell_idx"), "cell_idx", "left_semi"), labels


def check_clusters(labels: DataFrame, selected: Sequence[int] | None) -> list[int]:
    """The cluster ids of the labels, one per cluster, checked against a selection."""
    present = sorted(r[0] for r in labels.select("cluster_id").distinct().collect())
    wanted = present if selected is None else list(dict.fromkeys(selected))
    if not set(wanted) <= set(present):
        raise ValueError(f"cluster ids must be among {present}")
    return wanted


def find_markers(
    exp: Experiment,
    lfc_th: float,
    q_th: float,
    selected_clusters: Sequence[int] | None = None,
    nDE: int = 30,
    sample_length: int | None = 100,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``(genes_df, markers)``.

    ``markers(cluster_id, gene_idx, symbol, pvalue, qvalue, lfc)`` lists every
    significant gene per cluster; ``genes_df`` shows the top ``nDE`` symbols side
    by side. Selected clusters are tested against all other sampled cells.
    """
    expr, labels = reduce_for_markers(exp, sample_length, seed)
    wanted = check_clusters(labels, selected_clusters)
    tested = test_markers(expr, labels).where(F.col("cluster_id").isin(wanted))
    found = significant(tested, lfc_th, q_th).join(exp.genes.select("gene_idx", "symbol"), "gene_idx")
    found = materialize(found.select("cluster_id", "gene_idx", "symbol", "pvalue", "qvalue", "lfc"), "markers")
    return markers_wide(top_markers(found, nDE), wanted), found
