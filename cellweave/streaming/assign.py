"""Post-hoc assignment of cells that arrive after the model was built.

The sampled cells and their labels are frozen, so a new cell is assigned from its
own vector alone: a stateless stream-static job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators.cluster import vote
from cellweave.operators.knn import nearest, searcher


def assign_batch(vectors: DataFrame, samples: DataFrame, labels: DataFrame, k_nn: int = 10, conf: float = 0.75) -> DataFrame:
    """``(cell_idx, cluster_id)`` for ``(cell_idx, vec)``; NULL below the confidence."""
    return _voted(nearest(vectors, samples, k_nn + 1), labels, conf)


def _voted(knn: DataFrame, labels: DataFrame, conf: float) -> DataFrame:
    return vote(knn, labels, conf).select("cell_idx", F.col("assigned").alias("cluster_id"))


def assign_stream(
    stream: DataFrame,
    samples: DataFrame,
    labels: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    k_nn: int = 10,
    conf: float = 0.75,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Assign every micro-batch of ``stream(cell_idx, vec)`` and hand it to ``sink(df, epoch)``.

    The sample is prepared once, before the first batch. A sink that overwrites
    by epoch makes the result exactly-once.
    """
    search = searcher(samples, k_nn + 1)

    def each(batch: DataFrame, epoch: int) -> None:
        sink(_voted(search(batch), labels, conf), epoch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
