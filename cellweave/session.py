"""Session settings and stage tables.

Stages that several later steps read are written once as Parquet in the folder
the cluster names in ``spark.checkpoint.dir``. A written table survives the loss
of an executor, keeps column pruning and filter pushdown for its readers, and
gives the optimizer real sizes to choose joins by.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_roots: dict[str, str] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for stage tables.

    Uses the session's setting. Only a local session may fall back to a folder
    of its own; on a cluster a machine-local folder would be lost with its node.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="cellweave-")
    return _local_roots[app]


def materialize_with(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` and return its reader with totals taken while writing, in one job."""
    seen = Observation()
    written = materialize(df.observe(seen, *[c.alias(k) for k, c in totals.items()]), name)
    return written, seen.get


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside send batches of about ``most`` bytes to Python, unless the session sets a size itself."""
    if spark.conf.get(_BATCH_KEY, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_KEY, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY)


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy", **options: int | str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table; ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
