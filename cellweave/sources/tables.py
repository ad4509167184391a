"""Views of a star schema as count matrices, labels and vectors.

The order history of a shop has the same shape as an expression matrix: customers
are cells, the things they buy are genes and the summed quantity is the count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.session import materialize
from cellweave.sources.files import exists, last_change

_written: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per session, again if its inputs have changed or its files were cleaned away.

    ``key`` begins with the folder of the inputs.
    """
    key = (spark.sparkContext.applicationId, *key, last_change(spark, key[0]))
    held = _written.get(key)
    if held is None or not all(exists(spark, f) for f in held.inputFiles()[:1]):
        _written[key] = materialize(build(), "-".join(str(k) for k in key[2:-1]))
    return _written[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def count_matrix(spark: SparkSession, folder: str, gene: str = "part") -> DataFrame:
    """``expr(cell_idx, gene_idx, count)`` with genes = part, supplier or brand."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_idx"))
    if gene == "brand":
        brands = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.expr("CAST(substring(p_brand, 7) AS BIGINT)").alias("gene_idx"),
        )
        lines = lines.join(brands, "l_partkey")
    else:
        lines = lines.withColumn("gene_idx", F.col({"part": "l_partkey", "supplier": "l_suppkey"}[gene]))
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .groupBy("cell_idx", "gene_idx")
        .agg(F.sum("l_quantity").alias("count"))
        .where(F.col("count") != 0)
    )


def stored_matrix(spark: SparkSession, folder: str, gene: str = "part") -> DataFrame:
    """The count matrix written once per session, as an input that many queries share."""
    return once(spark, (folder, "matrix", gene), lambda: count_matrix(spark, folder, gene))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer, also those that never ordered; ids count from 0 in the tables."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cell_idx"),
        F.col("c_name").alias("cell_id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )


def genes(spark: SparkSession, folder: str, gene: str = "part") -> DataFrame:
    if gene == "brand":
        return (
            table(spark, folder, "part")
            .select(F.expr("CAST(substring(p_brand, 7) AS BIGINT)").alias("gene_idx"), F.col("p_brand").alias("symbol"))
            .distinct()
        )
    if gene == "supplier":
        return table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("gene_idx"), F.col("s_name").alias("symbol")
        )
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("gene_idx"), F.concat_ws("_", F.lit("part"), "p_partkey").alias("symbol")
    )


def segment_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``(cell_idx, cluster_id)`` with the market segment as the cluster, numbered from 1 in name order."""
    held = cells(spark, folder)
    order = Window.partitionBy(F.lit(0)).orderBy("segment")  # one row per segment
    numbers = held.select("segment").distinct().withColumn("cluster_id", F.row_number().over(order))
    return held.join(numbers, "segment").select("cell_idx", "cluster_id")


def nation_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``(cell_idx, cluster_id)`` with the nation as the cluster; keys count from 0, clusters from 1."""
    return cells(spark, folder).select("cell_idx", (F.col("nation") + 1).cast("long").alias("cluster_id"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(cell_idx, vec, label)`` from the embeddings table, in double precision."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cell_idx"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
