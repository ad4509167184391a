"""Saving and loading experiments, and the format switch of the readers."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from cellweave.model import Experiment
from cellweave.sources.delimited import read_delimited
from cellweave.sources.files import exists
from cellweave.sources.tenx import read_10x


def read_files(spark: SparkSession, paths, format: str = "10x", **options) -> Experiment:
    """Read 10x directories (``10x``) or delimited matrices (``txt``)."""
    readers = {"10x": read_10x, "txt": read_delimited}
    if format.lower() not in readers:
        raise ValueError(f"unknown format {format}")
    return readers[format.lower()](spark, paths, **options)


def save(exp: Experiment, folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table per part.

    The matrix is range-partitioned by gene, then cell, so that a gene selection
    skips row groups and a gene seen everywhere is spread over several files.
    """
    exp.expr.repartitionByRange("gene_idx", "cell_idx").sortWithinPartitions("gene_idx", "cell_idx").write.mode(mode).parquet(f"{folder}/expr")
    exp.cells.write.mode(mode).parquet(f"{folder}/cells")
    exp.genes.write.mode(mode).parquet(f"{folder}/genes")
    if exp.knn is not None:
        exp.knn.write.mode(mode).parquet(f"{folder}/knn")
    for kind, tables in (("embeddings", exp.embeddings), ("tables", exp.tables)):
        for name, df in tables.items():
            df.write.mode(mode).parquet(f"{folder}/{kind}/{name}")
    meta = {"steps": exp.steps, "embeddings": list(exp.embeddings), "tables": list(exp.tables), "knn": exp.knn is not None}
    exp.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Experiment:
    if not exists(spark, f"{folder}/meta"):
        raise FileNotFoundError(f"no experiment in {folder}")
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Experiment(
        expr=read("expr"), cells=read("cells"), genes=read("genes"),
        knn=read("knn") if meta["knn"] else None,
        embeddings={n: read(f"embeddings/{n}") for n in meta["embeddings"]},
        tables={n: read(f"tables/{n}") for n in meta["tables"]},
        steps=tuple((name, params) for name, params in meta["steps"]),
    )
