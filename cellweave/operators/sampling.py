"""Structure-preserving and random sampling of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.hashing import take_by_hash
from cellweave.functions.numeric import decay_quota, log2p1
from cellweave.model import Experiment, update_column
from cellweave.operators.graph import graph_edges, louvain
from cellweave.operators.knn import nearest
from cellweave.operators.vectors import dense_vectors
from cellweave.session import materialize

# Bounds of the pre-sample and of the searched decay parameters,
# and the neighbours (the cell itself included) in the partition graph.
PRESAMPLE_LIMIT = 20_000
PRESAMPLE_SHARE = 3
GRAPH_NEIGHBOURS = 6
PARAMETER_BOUNDS = {"pinit": (0.05, 0.1), "pfin": (0.9, 0.95), "scale": (500, 4000)}
PARAMETER_STEPS = {"pinit": 6, "pfin": 6, "scale": 36}


def presample_size(n: Column) -> Column:
    limited = F.least(F.lit(PRESAMPLE_LIMIT), F.bround(n / PRESAMPLE_SHARE).cast("int"))
    return F.when(n < PRESAMPLE_LIMIT, n).otherwise(limited)


def presample(cells: DataFrame, seed: int = 0) -> DataFrame:
    """All cells if fewer than 20,000, else a random third of at most 20,000.

    The sample that models are fitted on; results for all cells are derived from them.
    """
    return take_by_hash(cells, "cell_idx", presample_size, seed=seed)


def random_sample(cells: DataFrame, nsamples: int = 500, seed: int = 0) -> DataFrame:
    """``nsamples`` of all cells."""
    return take_by_hash(cells, "cell_idx", nsamples, seed=seed)


def partition_sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("part").agg(F.count(F.lit(1)).alias("size"))


def sps_quota(partition: DataFrame, pinit: float = 0.195, pfin: float = 0.9, scale: float = 500) -> DataFrame:
    """``(part, size, quota)``: cells to draw from every part."""
    return partition_sizes(partition).withColumn("quota", decay_quota(F.col("size"), pinit, pfin, scale))


def sps_sample(
    partition: DataFrame, pinit: float = 0.195, pfin: float = 0.9, scale: float = 500, seed: int = 0
) -> DataFrame:
    """Draw every part's quota without replacement from ``(cell_idx, part)``."""
    return take_by_hash(partition, "cell_idx", lambda size: decay_quota(size, pinit, pfin, scale), ["part"], seed)


def stratified_sample(labels: DataFrame, sample_length: int | None = 100, seed: int = 0) -> DataFrame:
    """At most ``sample_length`` cells per cluster; cells of no cluster or cluster 0 are left out."""
    known = labels.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != 0))
    if sample_length is None:
        return known
    return take_by_hash(known, "cell_idx", sample_length, ["cluster_id"], seed)


def parameter_grid() -> dict[str, list[float]]:
    return {
        name: [float(x) for x in np.linspace(low, high, PARAMETER_STEPS[name])]
        for name, (low, high) in PARAMETER_BOUNDS.items()
    }


def sps_param_search(partition: DataFrame, nsamples: int = 500) -> DataFrame:
    """One row ``(pinit, pfin, scale, total, miss)`` whose total draw is closest to ``nsamples``.

    The part sizes are opened against a fixed grid over the parameter bounds;
    ties go to the smallest parameters.
    """
    sizes = partition_sizes(partition)
    for name, values in parameter_grid().items():
        sizes = sizes.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    quota = decay_quota(F.col("size"), F.col("pinit"), F.col("pfin"), F.col("scale"))
    totals = sizes.groupBy("pinit", "pfin", "scale").agg(F.sum(quota).alias("total"), F.sum("size").alias("all_cells"))
    miss = F.abs(F.col("total") - F.least(F.col("all_cells"), F.lit(nsamples)))
    best = totals.agg(F.min(F.struct(miss.alias("miss"), "pinit", "pfin", "scale", "total")).alias("b"))
    return best.select("b.pinit", "b.pfin", "b.scale", "b.total", "b.miss")


def neighbour_partition(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """``(cell_idx, part)``: modularity clusters of the nearest-neighbour graph."""
    edges = graph_edges(nearest(vectors, vectors, GRAPH_NEIGHBOURS))
    parts = louvain(edges, seed).select(F.col("node").alias("cell_idx"), F.col("community").alias("part"))
    return vectors.select("cell_idx").join(parts, "cell_idx", "left").na.fill(0, ["part"])


def sample_cells(
    exp: Experiment,
    nsamples: int = 500,
    method: str = "sps",
    optm_parameters: bool = False,
    pinit: float = 0.195,
    pfin: float = 0.9,
    scale: float = 500,
    seed: int = 0,
) -> Experiment:
    """Flag sampled cells in ``cells.sampled``.

    ``sps`` draws from the clusters of a neighbour graph, large clusters at a
    lower rate; ``random`` draws ``nsamples`` cells. With ``optm_parameters`` the
    decay parameters are chosen so that about ``nsamples`` cells are drawn.
    """
    if method not in ("sps", "random"):
        raise ValueError(f"unknown sampling method {method}")
    if nsamples >= exp.cells.count():
        return exp.evolve(cells=exp.cells.withColumn("sampled", F.lit(True)))
    if method == "random":
        drawn = random_sample(exp.cells.select("cell_idx"), nsamples, seed)
    else:
        exp.require("norm")
        pool = materialize(presample(exp.cells.select("cell_idx"), seed), "pool")
        if "CComponents" in exp.embeddings:
            features = dense_vectors(exp.expr, pool, exp.genes, F.col("norm"))
        else:
            exp.require("hvg")
            features = dense_vectors(exp.expr, pool, exp.genes.where("hvg"), log2p1("norm"))
        partition = materialize(neighbour_partition(materialize(features, "vectors"), seed), "partition")
        if optm_parameters:
            pinit, pfin, scale = sps_param_search(partition, nsamples).select("pinit", "pfin", "scale").first()
        drawn = sps_sample(partition, pinit, pfin, scale, seed)
    flags = materialize(drawn.select("cell_idx", F.lit(True).alias("sampled")), "sampled")
    return exp.evolve(
        "sample_cells",
        {"method": method, "pinit": pinit, "pfin": pfin, "scale": scale, "seed": seed},
        cells=update_column(exp.cells, flags, "cell_idx", {"sampled": False}),
    )
