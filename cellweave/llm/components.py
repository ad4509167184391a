"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialize_with


def _hooked(pairs: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    linked = pairs.join(least, "a")
    return linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge; the root is the component's least node.

    ``edges`` has two comparable columns ``a`` and ``b`` in any order. Large-star and
    small-star rounds alternate until the edges no longer change; the number of rounds
    grows with the logarithm of the component size. Each round is a written table.
    """
    tidy = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = {"n": F.count(F.lit(1)), "s": F.bit_xor(F.xxhash64("a", "b"))}
    pairs, seen = materialize_with(tidy, "edges", **mark)
    while seen["n"]:
        large = _hooked(pairs, True).distinct()
        small, now = materialize_with(_hooked(large, False).distinct(), "edges", **mark)
        if (now["n"], now["s"]) == (seen["n"], seen["s"]):
            break
        pairs, seen = small, now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
