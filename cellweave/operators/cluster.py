"""Cluster the sampled cells, then let every cell follow its sampled neighbours."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.model import Experiment, update_column
from cellweave.operators.graph import graph_edges, louvain
from cellweave.operators.knn import nearest
from cellweave.operators.linkage import hierarchical_labels
from cellweave.operators.vectors import dense_vectors
from cellweave.session import materialize

# Fixed value: neighbours, the cell itself included, in the clustering graph.
GRAPH_NEIGHBOURS = 10

LOUVAIN_NAMES = ("louvain", "louvian", "default")


def vote(knn: DataFrame, labels: DataFrame, conf: float = 0.75) -> DataFrame:
    """``(cell_idx, n_neighbours, label, votes, assigned)`` for every searched cell.

    ``labels(cell_idx, label)`` covers sampled cells. The most frequent label
    wins, ties go to the smallest, and it is assigned only if its share of all
    neighbours (labelled or not) is strictly above ``conf``.
    """
    named = labels.select(F.col("cell_idx").alias("nn_cell_idx"), "label")
    ballots = (
        knn.join(named, "nn_cell_idx", "left")
        .groupBy("cell_idx", "label")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    won = ballots.groupBy("cell_idx").agg(
        F.sum("votes").alias("n_neighbours"),
        F.max(F.when(F.col("label").isNotNull(), F.struct("votes", (-F.col("label")).alias("minus")))).alias("top"),
    )
    label, votes = -F.col("top.minus"), F.coalesce(F.col("top.votes"), F.lit(0))
    return won.select(
        "cell_idx",
        "n_neighbours",
        label.alias("label"),
        votes.alias("votes"),
        F.when(votes / F.col("n_neighbours") > conf, label).alias("assigned"),
    )


def relabel(votes: DataFrame, sampled: DataFrame) -> DataFrame:
    """``(cell_idx, cluster_id)``: labels that no sampled cell received are dropped,
    the others are renumbered 1, 2, ... in label order."""
    held = (
        votes.join(sampled.select("cell_idx"), "cell_idx", "left_semi")
        .where(F.col("assigned").isNotNull())
        .select("assigned")
        .distinct()
    )
    # One row per cluster, at most one per sampled cell.
    numbered = held.withColumn("cluster_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("assigned")))
    return votes.join(numbered, "assigned", "left").select("cell_idx", "cluster_id")


def louvain_labels(vectors: DataFrame, seed: int = 0) -> DataFrame:
    edges = graph_edges(nearest(vectors, vectors, GRAPH_NEIGHBOURS))
    return louvain(edges, seed).select(F.col("node").alias("cell_idx"), F.col("community").alias("label"))


def kmeans_labels(vectors: DataFrame, centers: int, seed: int = 0, max_iter: int = 20) -> DataFrame:
    points = vectors.select("cell_idx", array_to_vector("vec").alias("features"))
    model = KMeans(k=centers, seed=seed, maxIter=max_iter).fit(points)
    return model.transform(points).select("cell_idx", (F.col("prediction") + 1).alias("label"))


def cluster_vectors(vectors: DataFrame, method: str = "louvain", seed: int = 0, **options) -> DataFrame:
    """``(cell_idx, label)`` for ``(cell_idx, vec)`` by one of the clustering methods."""
    if method in LOUVAIN_NAMES:
        return louvain_labels(vectors, seed)
    if method == "kmeans":
        if "centers" not in options:
            raise ValueError("kmeans needs centers")
        return kmeans_labels(vectors, seed=seed, **options)
    if method == "hclust":
        return hierarchical_labels(vectors, **options)
    raise ValueError(f"unknown clustering method {method}")


def selected_genes(exp: Experiment) -> DataFrame:
    """Component genes if they were ranked, else the variable genes."""
    if "pca_gene" in exp.genes.columns:
        return exp.genes.where("pca_gene")
    exp.require("hvg")
    return exp.genes.where("hvg")


def cluster_cells(
    exp: Experiment,
    use_subsamples: bool = True,
    method: str = "louvain",
    use_reduced_dims: str | None = None,
    k_nn: int = 10,
    conf: float = 0.75,
    use_previous: bool = False,
    seed: int = 0,
    **options,
) -> Experiment:
    """Assign ``cells.cluster_id``.

    On corrected dimensions (``CComponents``, or ``use_reduced_dims``) all cells
    are clustered directly. Otherwise the sampled cells are clustered on the
    selected genes, and every cell takes the majority label of its ``k_nn`` + 1
    nearest sampled cells, or none below the confidence. ``use_previous`` keeps
    neighbours and sample labels of the last run and only votes again.
    """
    family = "louvain" if method in LOUVAIN_NAMES else method
    params = {"method": family, "k_nn": k_nn, "conf": conf, "seed": seed, **options}
    reduced = "CComponents" if "CComponents" in exp.embeddings else use_reduced_dims
    if reduced is not None:
        if reduced not in exp.embeddings:
            raise ValueError(f"embedding {reduced} not found")
        labels = cluster_vectors(exp.embeddings[reduced], method, seed, **options)
        labels = materialize(labels.withColumnRenamed("label", "cluster_id"), "clusters")
        return exp.evolve("cluster_cells", params, cells=update_column(exp.cells, labels, "cell_idx"))

    if use_subsamples:
        exp.require("sampled")
    sampled = exp.cells.where("sampled") if use_subsamples else exp.cells
    previous = exp.last("cluster_cells")
    again = use_previous and exp.knn is not None and previous is not None and previous["method"] == family
    if not again:
        exp.require("norm")
        vectors = dense_vectors(exp.expr, exp.cells, selected_genes(exp), log2p1("norm"))
        vectors = materialize(vectors, "vectors")
        inside = materialize(vectors.join(sampled, "cell_idx", "left_semi"), "inside")
        labels = materialize(cluster_vectors(inside, method, seed, **options), "labels")
        knn = materialize(nearest(vectors, inside, k_nn + 1), "knn")
        cells = update_column(
            exp.cells, labels.select("cell_idx", F.col("label").alias("sample_cluster_id")), "cell_idx"
        )
        exp = exp.evolve(knn=knn, cells=cells)
    known = exp.cells.where(F.col("sample_cluster_id").isNotNull()).select(
        "cell_idx", F.col("sample_cluster_id").alias("label")
    )
    clusters = relabel(materialize(vote(exp.knn, known, conf), "votes"), known)
    cells = materialize(update_column(exp.cells, clusters, "cell_idx"), "cells")
    return exp.evolve("cluster_cells", params, cells=cells)
