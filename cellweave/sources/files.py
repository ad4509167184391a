"""Text files with line numbers, and file checks on any Hadoop file system."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def last_change(spark: SparkSession, folder: str) -> int:
    """Time of the latest change of anything right below a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((f.getModificationTime() for f in system.listStatus(target)), default=0)


def parts(spark: SparkSession, file: str) -> list[str]:
    """The files that make up a file or a folder of parts, in the order of their names."""
    return sorted(unquote(f) for f in spark.read.text(file).inputFiles())


def numbered_lines(spark: SparkSession, file: str) -> DataFrame:
    """``(idx, line)`` with 0-based line numbers, read in parallel.

    Lines within a block of the file keep their order, so a line's number is the
    number of lines in earlier blocks plus its place in its own block. A folder of
    parts is one file, its parts in the order of their names.
    """
    rows = spark.read.text(file).select(
        F.col("value").alias("line"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one row per block of a file, at most some thousands
    return rows.join(F.broadcast(starts), "block").select(
        (F.col("start") + F.col("id") - F.col("first")).alias("idx"), "line"
    )
