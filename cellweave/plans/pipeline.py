"""The usual sequences of stages as single calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellweave.model import Experiment
from cellweave.operators.cluster import cluster_cells
from cellweave.operators.correction import correct_batches
from cellweave.operators.hvg import rank_genes
from cellweave.operators.markers import find_markers
from cellweave.operators.merge import merge_experiments
from cellweave.operators.normalize import normalize_counts
from cellweave.operators.pca_genes import rank_pca_genes
from cellweave.operators.qc import filter_cells, filter_genes
from cellweave.operators.sampling import sample_cells


def prepare(exp: Experiment, ngenes_keep: int = 1000) -> Experiment:
    """Filter, normalise and rank genes."""
    exp = filter_genes(filter_cells(exp)).written()
    return rank_genes(normalize_counts(exp), ngenes_keep)


def cluster_dataset(
    exp: Experiment, nsamples: int = 500, top: int = 200, method: str = "louvain", conf: float = 0.5, seed: int = 0, **options
) -> Experiment:
    """From raw counts to ``cells.cluster_id`` for one dataset."""
    exp = rank_pca_genes(sample_cells(prepare(exp), nsamples, seed=seed), top)
    return cluster_cells(exp, method=method, conf=conf, seed=seed, **options)


def integrate_batches(
    objects: Sequence[Experiment], centers: int, use_de_genes: bool = True, method: str = "default",
    lfc_th: float = 1.2, q_th: float = 0.001, nDE: int = 10, seed: int = 0, **options,
) -> tuple[Experiment, DataFrame, DataFrame]:
    """Merge, correct, cluster on the corrected dimensions and find markers."""
    merged = merge_experiments(objects, use_de_genes, seed)
    corrected = correct_batches(merged, method, seed=seed, **options)
    clustered = cluster_cells(corrected, method="kmeans", centers=centers, seed=seed)
    wide, found = find_markers(clustered, lfc_th, q_th, nDE=nDE, seed=seed)
    return clustered, wide, found
