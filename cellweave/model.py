"""The annotated count matrix as a set of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from cellweave.session import materialize

EXPR_SCHEMA = "cell_idx LONG, gene_idx LONG, count DOUBLE"


@dataclass(frozen=True)
class Experiment:
    """Counts in long form plus one table per axis.

    ``expr(cell_idx, gene_idx, count[, norm])`` holds non-zeros only; ``cells``
    and ``genes`` hold every cell and gene, also those without any count, and
    gain columns as stages run. ``knn(cell_idx, nn_rank, nn_cell_idx, dist)`` and
    ``embeddings[name](cell_idx, vec)`` appear with their stages. Every stage
    returns a new object and appends to ``steps``.
    """

    expr: DataFrame
    cells: DataFrame
    genes: DataFrame
    knn: DataFrame | None = None
    embeddings: Mapping[str, DataFrame] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    steps: tuple = ()

    @property
    def spark(self) -> SparkSession:
        return self.expr.sparkSession

    def evolve(self, step: str | None = None, params: Mapping | None = None, **changes) -> Experiment:
        steps = self.steps + (((step, dict(params or {})),) if step else ())
        return replace(self, steps=steps, **changes)

    def require(self, *needs: str) -> None:
        """Raise before any job runs if a stage's inputs are missing."""
        hints = {
            "norm": "run normalize_counts first",
            "hvg": "run rank_genes first",
            "pca_gene": "run rank_pca_genes first",
            "sampled": "run sample_cells first",
            "cluster_id": "run cluster_cells first",
            "knn": "run cluster_cells first",
            "batch": "run merge_experiments first",
        }
        for need in needs:
            here = self.knn is not None if need == "knn" else need in (
                self.expr.columns + self.cells.columns + self.genes.columns
            )
            if not here:
                raise ValueError(f"{need} not found: {hints.get(need, 'missing column')}")

    def last(self, step: str) -> dict | None:
        """Parameters of the latest run of a step."""
        return next((params for name, params in reversed(self.steps) if name == step), None)

    def register_views(self) -> None:
        """Temp views so that every stage can be queried with SQL."""
        views = {"expr": self.expr, "cells": self.cells, "genes": self.genes, "knn": self.knn}
        views |= {f"embedding_{name}": df for name, df in self.embeddings.items()} | dict(self.tables)
        for name, df in views.items():
            if df is not None:
                df.createOrReplaceTempView(name)

    def written(self) -> Experiment:
        """Cut the lineage: write the tables and continue from them."""
        return replace(
            self,
            expr=materialize(self.expr, "expr"),
            cells=materialize(self.cells, "cells"),
            genes=materialize(self.genes, "genes"),
            knn=None if self.knn is None else materialize(self.knn, "knn"),
        )


def update_column(table: DataFrame, values: DataFrame, key: str, fill: Mapping | None = None) -> DataFrame:
    """Left-join new columns onto an axis table, replacing older ones of the same name."""
    new = [c for c in values.columns if c != key]
    joined = table.drop(*new).join(values, key, "left")
    return joined.na.fill(dict(fill)) if fill else joined
