"""Delimited matrices: one line per gene, one column per cell."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.text import make_unique, zero_padded
from cellweave.model import Experiment
from cellweave.operators.merge import CELL_STRIDE
from cellweave.session import materialize
from cellweave.sources.files import numbered_lines


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", header: bool = True, quote: str = '"'
) -> Experiment:
    """Read matrices with equal gene lists as one experiment.

    With a header and text in the first column, that column names the genes;
    otherwise genes are ``gene_001``, ``gene_002``, ...; cells without a header are
    ``cell_1``, ... Barcodes of several files are prefixed by the file number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    exprs, cells, genes = None, None, None
    for i, path in enumerate(paths):
        wide, barcodes, names = _read_one(spark, path, sep, header, quote)
        if genes is None:
            genes = names
        elif not genes.exceptAll(names).isEmpty() or not names.exceptAll(genes).isEmpty():
            raise ValueError("gene information differs between sets")
        shift = F.lit(i * CELL_STRIDE) if i else F.lit(0).cast("long")
        label = F.concat(F.lit(f"{i + 1}_"), "barcode") if len(paths) > 1 else F.col("barcode")
        counts = wide.withColumn("cell_idx", F.col("cell_idx") + shift)
        here = barcodes.select(
            (F.col("cell_idx") + shift).alias("cell_idx"), label.alias("cell_id"), "barcode", F.lit(path).alias("sample_src")
        )
        exprs = counts if exprs is None else exprs.unionByName(counts)
        cells = here if cells is None else cells.unionByName(here)
    genes = make_unique(genes, "gene_id", "gene_idx", "symbol")
    return Experiment(materialize(exprs, "expr"), materialize(cells, "cells"), materialize(genes, "genes"))


def wide_to_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "count") -> DataFrame:
    """Unpivot named numeric columns and keep the non-zeros."""
    return wide.unpivot(list(keys), list(columns), name, value).where(F.col(value) != 0)


def split_fields(line: Column, sep: str, quote: str = '"') -> Column:
    """Trimmed fields of a line, quotes taken away, in one pass over it.

    Every second piece between quotes stands inside them; its separators are
    hidden behind a character that text files do not hold. Nothing between two
    quotes that close and open again is a doubled quote, which stands for one.
    """
    hidden = F.lit("\x00")
    if quote:
        pieces = F.split(line, re.escape(quote), -1)
        doubled = lambda p, i: (p == "") & (i > 0) & (i < F.size(pieces) - 1)
        shown = F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(sep), hidden)).when(doubled(p, i), F.lit(quote)).otherwise(p),
        )
        line = F.when(F.contains(line, F.lit(quote)), F.array_join(shown, "")).otherwise(line)
    return F.transform(F.split(line, re.escape(sep), -1), lambda f: F.trim(F.replace(f, hidden, F.lit(sep))))


def _read_one(spark: SparkSession, path: str, sep: str, header: bool, quote: str):
    """``(expr, cells, genes)`` of one file; only the header line visits the driver."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    fields = split_fields(F.col("line"), sep, quote)
    first = lines.select(fields.alias("f")).where(F.col("idx") == 0).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    body = materialize(lines.where(F.col("idx") >= (1 if header else 0)).select("idx", fields.alias("f")), "lines")
    probe = body.select("f").first()
    if probe is None:
        raise ValueError(f"{path} has no genes")
    named = header and not re.fullmatch(r"[-+0-9.eE]+", probe["f"][0])
    skip = 1 if named else 0
    width = len(probe["f"]) - skip
    titles = first["f"][-width:] if header else None
    if header and len(first["f"]) not in (width, width + skip):
        raise ValueError(f"the header of {path} names {len(first['f'])} columns, the first line has {len(probe['f'])} fields")
    ragged = body.where(F.size("f") != width + skip).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")).first()
    if ragged["n"]:
        raise ValueError(f"{ragged['n']} lines of {path} do not have {width + skip} fields, the first is line {ragged['first'] + 1}")
    rows = body.withColumn("gene_idx", F.col("idx") - (1 if header else 0))
    counts = rows.select("gene_idx", F.posexplode(F.slice("f", skip + 1, width)).alias("at", "text")).select(
        F.col("at").cast("long").alias("cell_idx"), "gene_idx", F.col("text").cast("double").alias("count")
    ).where(F.col("count") != 0)
    total = rows.agg(F.count(F.lit(1))).scalar()
    gene_id = F.col("f")[0] if named else zero_padded("gene", F.col("gene_idx") + 1, total)
    genes = rows.select("gene_idx", gene_id.alias("gene_id"))
    if header:
        frame = spark.createDataFrame([(j, t) for j, t in enumerate(titles)], "cell_idx long, barcode string")
    else:
        frame = spark.range(width).select(F.col("id").alias("cell_idx"), zero_padded("cell", F.col("id") + 1, F.lit(width)).alias("barcode"))
    return counts, frame, genes
