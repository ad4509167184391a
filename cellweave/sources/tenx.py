"""10x matrix directories: version 2 (plain files) and 3 (compressed, typed features)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.text import make_unique, strip_common_suffix
from cellweave.model import Experiment
from cellweave.operators.merge import CELL_STRIDE
from cellweave.session import materialize, materialize_with
from cellweave.sources.files import exists, numbered_lines, parts

EXPRESSION_TYPE = "Gene Expression"


def read_10x(
    spark: SparkSession,
    paths: str | Sequence[str] | Mapping[str, str],
    gene_column: int = 2,
    unique_features: bool = True,
    feature_type: str | None = None,
) -> Experiment:
    """Read one or more directories with equal features as one experiment.

    If features are typed, gene expression (or ``feature_type``) is returned; see
    ``read_10x_types`` for all types and the names of cells.
    """
    found = read_10x_types(spark, paths, gene_column, unique_features)
    wanted = feature_type or next(iter(found))
    if wanted not in found:
        raise ValueError(f"feature type must be among {sorted(found)}")
    return found[wanted]


def read_10x_types(
    spark: SparkSession,
    paths: str | Sequence[str] | Mapping[str, str],
    gene_column: int = 2,
    unique_features: bool = True,
) -> dict[str, Experiment]:
    """One experiment per feature type, gene expression first; untyped features are gene expression.

    All experiments share the cells. Cells of unnamed directories after the first are
    prefixed ``2_``, ``3_``, ...; a mapping prefixes every directory with its name.
    Features that differ between directories, indices outside the declared sizes, sizes
    that differ from the other files and matrices with more or fewer entries than
    declared raise errors.
    """
    named = isinstance(paths, Mapping)
    pairs = list(paths.items()) if named else [(None, p) for p in ([paths] if isinstance(paths, str) else paths)]
    exprs, cells, genes = None, None, None
    for i, (name, path) in enumerate(pairs):
        files = _files(spark, path)
        features = materialize(_features(spark, files["features"], gene_column, unique_features), "features")
        if genes is None:
            genes = features
        elif genes.columns != features.columns or not genes.exceptAll(features).isEmpty() or not features.exceptAll(genes).isEmpty():
            raise ValueError(f"features of {path} differ from those of {pairs[0][1]}")
        prefix = f"{name}_" if named else (f"{i + 1}_" if i else "")
        shift = F.lit(i * CELL_STRIDE) if i else F.lit(0).cast("long")
        barcodes = strip_common_suffix(numbered_lines(spark, files["barcodes"]).withColumnRenamed("line", "barcode"), "barcode")
        barcodes = materialize(
            barcodes.select(
                (F.col("idx") + shift).alias("cell_idx"),
                F.concat(F.lit(prefix), "barcode").alias("cell_id"),
                F.concat(F.lit(prefix), "barcode").alias("barcode"),
                F.lit(path).alias("sample_src"),
            ),
            "barcodes",
        )
        counts = _checked(spark, files["matrix"], features.count(), barcodes.count()).withColumn("cell_idx", F.col("cell_idx") + shift)
        exprs = counts if exprs is None else exprs.unionByName(counts)
        cells = barcodes if cells is None else cells.unionByName(barcodes)
    cells = materialize(cells, "cells")
    if "feature_type" not in genes.columns:
        return {EXPRESSION_TYPE: Experiment(exprs, cells, genes)}
    types = {r[0] for r in genes.select("feature_type").distinct().collect()}  # a handful of assay names
    found = {}
    for kind in sorted(types, key=lambda t: (t != EXPRESSION_TYPE, t is None, t)):
        own = materialize(genes.where(F.col("feature_type").eqNullSafe(F.lit(kind))), "genes")
        found[kind] = Experiment(materialize(exprs.join(own.select("gene_idx"), "gene_idx", "left_semi"), "expr"), cells, own)
    return found


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    if not exists(spark, path):
        raise FileNotFoundError(f"directory {path} does not exist")
    old = exists(spark, f"{path}/genes.tsv")
    end = "" if old else ".gz"
    files = {
        "barcodes": f"{path}/barcodes.tsv{end}",
        "features": f"{path}/genes.tsv" if old else f"{path}/features.tsv.gz",
        "matrix": f"{path}/matrix.mtx{end}",
    }
    for what, file in files.items():
        if not exists(spark, file):
            raise FileNotFoundError(f"{what} file {file} missing")
    return files


def _features(spark: SparkSession, file: str, gene_column: int, unique: bool) -> DataFrame:
    lines = numbered_lines(spark, file)
    parts = F.split("line", "\t")
    width = lines.agg(F.max(F.size(parts))).first()[0]
    if gene_column > width:
        raise ValueError(f"gene_column is {gene_column} but {file} has {width} columns")
    at = lambda n: F.nullif(F.nullif(F.get(parts, F.lit(n - 1)), F.lit("")), F.lit("NA"))
    name = F.coalesce(at(gene_column), at(1 if gene_column == 2 else 2))
    genes = lines.select(
        F.col("idx").alias("gene_idx"), at(1).alias("source_id"), name.alias("symbol"),
        *([at(3).alias("feature_type")] if width > 2 else []),
    )
    if unique:
        genes = make_unique(genes, "symbol", "gene_idx", "unique_name").drop("symbol").withColumnRenamed("unique_name", "symbol")
    return genes.withColumn("gene_id", F.col("symbol"))


def _checked(spark: SparkSession, file: str, n_genes: int, n_cells: int) -> DataFrame:
    """The written non-zero entries of a matrix file after comparing them with what it and the other files declare."""
    entries, sizes = _coordinates(spark, file)
    if sizes[:2] != (n_genes, n_cells):
        raise ValueError(f"{file} declares {sizes[0]} features and {sizes[1]} cells, the other files hold {n_genes} and {n_cells}")
    inside = F.col("gene_idx").between(0, n_genes - 1) & F.col("cell_idx").between(0, n_cells - 1) & F.col("count").isNotNull()
    written, seen = materialize_with(entries, "entries", n=F.count(F.lit(1)), wrong=F.count_if(~F.coalesce(inside, F.lit(False))))
    if seen["wrong"]:
        raise ValueError(f"{file} has {seen['wrong']} entries that are no numbers or lie outside the declared sizes")
    if seen["n"] != sizes[2]:
        raise ValueError(f"{file} declares {sizes[2]} entries and has {seen['n']}")
    return written.where(F.col("count") != 0)


def _coordinates(spark: SparkSession, file: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Entries of a MatrixMarket coordinate file, 1-based gene and cell made 0-based, and the declared sizes.

    The size line looks like an entry: it is the first line that is no comment and
    is left out by its row id, found by looking at the start of the first part only. A
    plain file is read by many tasks, a compressed part by one task and then spread.
    """
    told = ~F.col("value").startswith("%") & (F.trim("value") != "")
    size_line, later = None, parts(spark, file)
    while size_line is None and later:
        rows = spark.read.text(later.pop(0)).withColumn("id", F.monotonically_increasing_id()).where(told)
        size_line = rows.first()
    sizes = re.fullmatch(r"\s*(\d+)\s+(\d+)\s+(\d+)\s*", size_line["value"]) if size_line else None
    if sizes is None:
        raise ValueError(f"{file} has no size line")
    rows = rows.where(F.col("id") != size_line["id"]).select("value")
    if later:
        rows = rows.union(spark.read.text(later).where(told))
    fields = F.split(F.trim("value"), r"\s+")
    number = lambda i, kind: F.get(fields, F.lit(i)).try_cast(kind)
    value = F.when(F.size(fields) == 2, F.lit(1.0)).when(F.size(fields) == 3, number(2, "double"))
    entries = rows.select(
        (number(1, "long") - 1).alias("cell_idx"), (number(0, "long") - 1).alias("gene_idx"), value.alias("count")
    )
    entries = entries.repartition("cell_idx", "gene_idx") if file.endswith(".gz") else entries
    return entries, tuple(int(x) for x in sizes.groups())
