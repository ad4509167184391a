"""cellweave: single-cell expression analytics on Spark DataFrames."""

from cellweave.model import Experiment
from cellweave.operators.cluster import cluster_cells
from cellweave.operators.correction import correct_batches
from cellweave.operators.embed import embed_cells
from cellweave.operators.hvg import rank_genes
from cellweave.operators.markers import find_markers, reduce_for_markers
from cellweave.operators.merge import merge_experiments
from cellweave.operators.normalize import normalize_counts
from cellweave.operators.pca_genes import rank_pca_genes
from cellweave.operators.qc import filter_cells, filter_genes
from cellweave.operators.sampling import sample_cells
from cellweave.functions.numeric import log2p1
from cellweave.plans.figures import heatmap, marker_plot, scatter_plot
from cellweave.plans.pipeline import cluster_dataset, integrate_batches, prepare
from cellweave.sources.store import load, read_files, save

__all__ = [
    "Experiment", "cluster_cells", "cluster_dataset", "correct_batches", "embed_cells", "filter_cells", "filter_genes",
    "find_markers", "heatmap", "integrate_batches", "load", "log2p1", "marker_plot", "merge_experiments",
    "normalize_counts", "prepare", "rank_genes", "rank_pca_genes", "read_files", "reduce_for_markers", "sample_cells",
    "save", "scatter_plot",
]
