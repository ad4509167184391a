"""Exact nearest neighbours of every cell among a sample of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ballindex import PAGE_ROWS, build_index, distances, prepared, smallest
from cellweave.operators.vectors import list_matrix, matrix_list
from cellweave.session import materialize

BROADCAST_BYTES = 32 * 2**20  # the driver holds such a sample several times while it is sent


def nearest(
    queries: DataFrame,
    samples: DataFrame,
    k: int,
    metric: str = "cosine",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """``knn(cell_idx, nn_rank, nn_cell_idx, dist)`` for frames of ``(cell_idx, vec)``.

    A sample within ``budget`` bytes is broadcast and every task multiplies its
    own batch of cells with it. A larger sample is indexed by balls and pages, and
    cells visit the pages that can hold a neighbour. Both ways give the same rows.
    """
    return searcher(samples, k, metric, budget)(queries)


def searcher(
    samples: DataFrame, k: int, metric: str = "cosine", budget: int = BROADCAST_BYTES
) -> Callable[[DataFrame], DataFrame]:
    """``nearest`` for a sample that is prepared once and asked again and again."""
    samples = materialize(samples.select("cell_idx", "vec"), "sample")
    n, width = samples.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no sampled cells to search")
    if n * width * 8 > budget:
        page = max(1, min(PAGE_ROWS, budget // (8 * width)))
        index = build_index(samples, metric, page)
        return lambda queries: index.search(queries.select("cell_idx", "vec"), k)
    search = _broadcast_search(samples, min(k, n), metric)
    hit = F.posexplode(F.arrays_zip("nn", "dist")).alias("nn_rank", "hit")
    return lambda queries: search(queries.select("cell_idx", "vec")).select("cell_idx", hit).select(
        "cell_idx", (F.col("nn_rank") + 1).alias("nn_rank"), F.col("hit.nn").alias("nn_cell_idx"), F.col("hit.dist").alias("dist")
    )


def _broadcast_search(samples: DataFrame, k: int, metric: str) -> Callable[[DataFrame], DataFrame]:
    held = samples.orderBy("cell_idx").toArrow()  # within the byte budget checked by the caller
    model = samples.sparkSession.sparkContext.broadcast(
        (held.column("cell_idx").to_numpy(), prepared(list_matrix(held.column("vec")), metric))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sample = model.value
        step = max(1, (32 * 2**20) // (8 * len(ids)))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = prepared(list_matrix(batch.column("vec")), metric)
            nn = np.empty((batch.num_rows, k), dtype=np.int64)
            dist = np.empty((batch.num_rows, k))
            for at in range(0, batch.num_rows, step):
                block = distances(vectors[at:at + step], sample, metric)
                best = smallest(block, k)
                nn[at:at + step] = ids[best]
                dist[at:at + step] = np.take_along_axis(block, best, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell_idx"), matrix_list(nn), matrix_list(dist)], ["cell_idx", "nn", "dist"]
            )

    return lambda queries: queries.mapInArrow(search, "cell_idx long, nn array<long>, dist array<double>")


def mutual_pairs(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine", budget: int = BROADCAST_BYTES) -> DataFrame:
    """``(left_idx, right_idx, dist)`` where each is among the other's k nearest."""
    forth = nearest(left, right, k, metric, budget).select(
        F.col("cell_idx").alias("left_idx"), F.col("nn_cell_idx").alias("right_idx"), "dist"
    )
    back = nearest(right, left, k, metric, budget).select(
        F.col("cell_idx").alias("right_idx"), F.col("nn_cell_idx").alias("left_idx")
    )
    return forth.join(back, ["left_idx", "right_idx"])
