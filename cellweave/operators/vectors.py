"""From long-form counts to one dense vector per cell over a chosen gene set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GENES = 50_000  # a vector is one row; beyond this select genes first
DENSE_BYTES = 32 * 2**20  # dense values made at once in a task


def gene_positions(genes: DataFrame) -> DataFrame:
    """``(gene_idx, pos)`` numbering a bounded gene selection from 0."""
    return genes.select("gene_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_idx")) - 1).alias("pos"))


def list_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column of equally long lists as a 2-D array, without copies per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix_list(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def dense_vectors(expr: DataFrame, cells: DataFrame, genes: DataFrame, value: Column) -> DataFrame:
    """``(cell_idx, vec)`` for every cell of ``cells``, zeros where nothing was counted.

    ``genes`` is a selection of at most ``MAX_GENES`` rows, so it is safe to broadcast
    and a cell's gathered entries fit in one row.
    """
    n_genes = genes.count()
    if n_genes > MAX_GENES:
        raise ValueError(f"{n_genes} genes are too many for dense vectors; select genes first")
    entries = (
        expr.join(F.broadcast(gene_positions(genes)), "gene_idx")
        .join(cells.select("cell_idx"), "cell_idx", "left_semi")
        .select("cell_idx", F.struct(F.col("pos").cast("int").alias("pos"), value.alias("value")).alias("entry"))
        .groupBy("cell_idx")
        .agg(F.collect_list("entry").alias("entries"))
    )
    listed = cells.select("cell_idx").join(entries, "cell_idx", "left").select(
        "cell_idx",
        F.coalesce(F.col("entries.pos"), F.array().cast("array<int>")).alias("pos"),
        F.coalesce(F.col("entries.value"), F.array().cast("array<double>")).alias("value"),
    )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE_BYTES // (8 * max(n_genes, 1)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                pos, values = batch.column("pos"), batch.column("value")
                dense = np.zeros((batch.num_rows, n_genes))
                rows = np.repeat(np.arange(batch.num_rows), np.diff(pos.offsets.to_numpy()))
                dense[rows, pos.flatten().to_numpy()] = values.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("cell_idx"), matrix_list(dense)], ["cell_idx", "vec"])

    return listed.mapInArrow(scatter, "cell_idx long, vec array<double>")
