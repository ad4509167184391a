"""Whole runs on planted data: recovery, not label equality."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellweave as cw
from cellweave.plans import catalogue, figures
from tests.conftest import agreement, experiment, planted_counts


@pytest.fixture(scope="module")
def clustered(spark):
    counts, group = planted_counts()
    exp = cw.prepare(experiment(spark, counts), ngenes_keep=80)
    exp = cw.sample_cells(exp, nsamples=100, pinit=0.5, pfin=0.9, seed=3)
    exp = cw.rank_pca_genes(exp, top=40)
    return cw.cluster_cells(exp, conf=0.5, seed=3), group


def recovered(exp, group):
    rows = exp.cells.where("cluster_id is not null").select("cell_idx", "cluster_id").toPandas()
    return agreement(rows["cluster_id"], group[rows["cell_idx"]]), len(rows)


def test_clusters_are_recovered(clustered):
    exp, group = clustered
    score, n = recovered(exp, group)
    assert score > 0.95 and n > 0.9 * len(group)
    assert [name for name, _ in exp.steps] == [
        "filter_cells", "filter_genes", "normalize_counts", "rank_genes", "sample_cells", "rank_pca_genes", "cluster_cells"
    ]
    n_sampled = exp.cells.where("sampled").count()
    assert 0 < n_sampled < exp.cells.count()


def test_revote_keeps_neighbours(clustered):
    exp, _ = clustered
    again = cw.cluster_cells(exp, conf=0.99, use_previous=True)
    assert again.knn is exp.knn
    assert again.cells.where("cluster_id is null").count() >= exp.cells.where("cluster_id is null").count()


def test_markers_name_the_planted_genes(clustered):
    exp, group = clustered
    wide, found = cw.find_markers(exp, lfc_th=0.5, q_th=0.001, nDE=5)
    width = 150 // 6
    rows = found.toPandas()
    assert set(rows["gene_idx"] // width) <= {0, 1, 2}
    assert rows.groupby("cluster_id")["gene_idx"].apply(lambda g: (g // width).nunique()).eq(1).all()
    assert wide.columns[0] == "rn" and wide.count() == 5
    with pytest.raises(ValueError):
        cw.find_markers(exp, lfc_th=0.5, q_th=0.001, selected_clusters=[99])
    heat = figures.heatmap(exp, found, nDE=3)
    z = heat["cells"].groupBy("gene_idx").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).toPandas()
    assert np.allclose(z["m"], 0, atol=1e-9) and np.allclose(z["s"], 1)
    plot = figures.marker_plot(exp, ["Gene0", "Gene30"])
    assert plot["summary"].count() == 2 * exp.cells.select("cluster_id").dropna().distinct().count()
    with pytest.raises(ValueError):
        figures.marker_plot(exp, ["nothing"])


@pytest.mark.parametrize("name,options", [("tsne", {"max_iter": 150}), ("umap", {"n_epochs": 30})])
def test_embedding_separates_groups(clustered, name, options):
    exp, group = clustered
    placed = cw.embed_cells(exp, name, seed=1, **options)
    rows = placed.embeddings[name].toPandas()
    xy = np.stack(rows["vec"])
    g = group[rows["cell_idx"]]
    centers = np.stack([xy[g == k].mean(axis=0) for k in range(3)])
    nearest = ((xy[:, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == g).mean() > 0.95
    scatter = cw.scatter_plot(placed)
    assert scatter["centers"].count() == len(scatter["colors"])


def test_hclust_sizes_cover_every_vector(spark):
    folder = "/root/testdata/sf0.01"
    sizes = catalogue.hclust_sizes(spark, folder).agg(F.sum("size")).first()[0]
    assert sizes == catalogue.vectors(spark, folder).count() > 250


@pytest.mark.parametrize("name,fit,rounds", [("umap_embed", "fit_umap", "n_epochs"), ("tsne_embed", "fit_tsne", "max_iter")])
def test_layout_queries_place_every_vector(spark, monkeypatch, name, fit, rounds):
    folder = "/root/testdata/sf0.01"
    monkeypatch.setattr(catalogue.embed, fit, partial(getattr(catalogue.embed, fit), **{rounds: 5}))
    ids = sorted(r.cell_idx for r in catalogue.QUERIES[name](spark, folder).where("x IS NOT NULL AND y IS NOT NULL").collect())
    assert ids == sorted(r.cell_idx for r in catalogue.vectors(spark, folder).collect()) and len(ids) > 300


@pytest.mark.parametrize("method,options", [("kmeans", {"centers": 3}), ("hclust", {"min_cluster_size": 10})])
def test_other_cluster_methods(clustered, method, options):
    exp, group = clustered
    score, _ = recovered(cw.cluster_cells(exp, method=method, conf=0.5, **options), group)
    assert score > 0.9


def test_missing_stages_are_named(spark):
    exp = experiment(spark, planted_counts(20, 12)[0])
    for stage in (cw.rank_genes, cw.rank_pca_genes, cw.cluster_cells, cw.correct_batches):
        with pytest.raises(ValueError):
            stage(exp)
    with pytest.raises(ValueError):
        cw.sample_cells(exp, nsamples=5, method="other")
    with pytest.raises(ValueError):
        cw.merge_experiments([exp])
    with pytest.raises(ValueError):
        cw.filter_cells(exp, ql_th=0.9, qh_th=0.1)
    assert cw.sample_cells(exp, nsamples=500).cells.where("sampled").count() == 20


@pytest.fixture(scope="module")
def batches(spark):
    parts = [planted_counts(150, 120, seed=s, shift=1.0 + s) for s in (0, 1)]
    return [experiment(spark, c) for c, _ in parts], np.concatenate([g for _, g in parts])


def batch_truth(exp):
    rows = exp.cells.select("cell_idx", "batch", "cell_id", "cluster_id").toPandas()
    return rows, rows["cell_id"].str[4:].astype(int) % 3


def test_merge_and_rank_correction(batches):
    objects, _ = batches
    merged = cw.merge_experiments(objects, use_de_genes=True, seed=1)
    assert {r[0] for r in merged.cells.select("batch").distinct().collect()} == {1, 2}
    assert merged.cells.count() == merged.cells.select("cell_idx").distinct().count()
    assert merged.genes.where("common_de").count() > 10
    corrected = cw.correct_batches(merged, close_th=0.1, cells_th=0.5, components=2, n_epochs=30, seed=1)
    assert corrected.embeddings["CComponents"].count() == merged.cells.count()
    clustered = cw.cluster_cells(corrected, method="kmeans", centers=3, seed=1)
    rows, truth = batch_truth(clustered)
    assert agreement(rows["cluster_id"], truth) > 0.9


def test_mutual_neighbour_correction(batches):
    objects, _ = batches
    merged = cw.merge_experiments(objects, use_de_genes=False)
    assert "common_de" not in merged.genes.columns
    corrected = cw.correct_batches(merged, method="fastmnn", d=10)
    clustered = cw.cluster_cells(corrected, method="kmeans", centers=3, seed=1)
    rows, truth = batch_truth(clustered)
    assert agreement(rows["cluster_id"], truth) > 0.9


def test_stack_keeps_cells_apart(spark):
    """Keys of an experiment read from two directories, and of merged ones, do not meet those of another batch."""
    from cellweave.operators.merge import CELL_STRIDE, stack

    counts, _ = planted_counts(n_cells=20, n_genes=12)
    one, two = experiment(spark, counts), experiment(spark, counts)
    moved = F.when(F.col("cell_idx") >= 10, F.col("cell_idx") + CELL_STRIDE).otherwise(F.col("cell_idx"))
    wide = one.evolve("moved", {}, expr=one.expr.withColumn("cell_idx", moved), cells=one.cells.withColumn("cell_idx", moved))
    expr, cells, _ = stack([wide, two])
    assert cells.select("cell_idx").distinct().count() == 40
    assert expr.select("cell_idx", "gene_idx").distinct().count() == 2 * one.expr.count()
    again, all_cells, _ = stack([wide.evolve("x", {}, expr=expr.drop("batch"), cells=cells.drop("batch")), wide])
    assert all_cells.select("cell_idx").distinct().count() == 60
