import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cellweave.model import Experiment
from pyspark.sql import SparkSession

from cellweave.session import materialize


@pytest.fixture(scope="session")
def spark():
    """A plain session: only what any session has, no setting of the library's own."""
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def planted_counts(n_cells=240, n_genes=150, n_groups=3, seed=0, shift=1.0):
    """Poisson counts with one block of raised genes per group of cells."""
    rng = np.random.default_rng(seed)
    group = np.arange(n_cells) % n_groups
    rate = np.full((n_cells, n_genes), 2.0 * shift) + rng.gamma(1.0, 1.0, n_genes)
    width = n_genes // (2 * n_groups)
    for g in range(n_groups):
        rate[np.ix_(group == g, np.arange(g * width, (g + 1) * width))] += 12.0
    return rng.poisson(rate), group


def experiment(spark, counts, names=None):
    cells, genes = np.nonzero(counts)
    expr = pd.DataFrame({"cell_idx": cells, "gene_idx": genes, "count": counts[cells, genes].astype(float)})
    n_cells, n_genes = counts.shape
    names = names or [f"Gene{j}" for j in range(n_genes)]
    cell_table = pd.DataFrame({"cell_idx": range(n_cells), "cell_id": [f"Cell{i}" for i in range(n_cells)]})
    gene_table = pd.DataFrame({"gene_idx": range(n_genes), "gene_id": names, "symbol": names})
    return Experiment(
        materialize(spark.createDataFrame(expr, "cell_idx long, gene_idx long, count double"), "expr"),
        materialize(spark.createDataFrame(cell_table, "cell_idx long, cell_id string"), "cells"),
        materialize(spark.createDataFrame(gene_table, "gene_idx long, gene_id string, symbol string"), "genes"),
    )


def agreement(a, b):
    """Adjusted Rand index."""
    table = pd.crosstab(pd.Series(a), pd.Series(b)).to_numpy()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    inner, rows, cols = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected = rows * cols / pairs(np.array([table.sum()]))
    return (inner - expected) / ((rows + cols) / 2 - expected)
