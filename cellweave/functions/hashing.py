"""Seeded, engine-independent sampling without replacement.

Each row gets the md5 of ``seed_id`` as its draw key. Taking the q smallest keys
of a group is an exact sample of size q. The first hex digits cut every group
into 4096 even buckets, so whole buckets are taken or left by their counts and
only the bucket that holds the q-th key is ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def draw_key(ident: str | Column, seed: int) -> Column:
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat_ws("_", F.lit(str(seed)), ident.cast("string")))


def take_by_hash(
    df: DataFrame,
    ident: str,
    quota: Callable[[Column], Column] | int,
    by: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Rows whose draw key is among the ``quota`` smallest of their group.

    ``quota`` is a number or maps the group size to a number of rows.
    """
    by = list(by)
    wanted = (lambda size: F.lit(quota)) if isinstance(quota, int) else quota
    keyed = df.withColumn("_key", draw_key(ident, seed))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, DIGITS))
    group = [F.col(c) for c in by] or [F.lit(0)]  # at most 4096 count rows per group
    whole = Window.partitionBy(*group)
    lower = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        counts.withColumn("_start", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .withColumn("_quota", wanted(F.sum("_n").over(whole)))
        .where(F.col("_start") < F.col("_quota"))
        .drop("_n")
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy("_key", ident)
    return (
        keyed.join(counts, [*by, "_bucket"])
        .withColumn("_rn", F.row_number().over(inner))
        .where(F.col("_start") + F.col("_rn") <= F.col("_quota"))
        .drop("_key", "_bucket", "_start", "_quota", "_rn")
        .select(*df.columns)
    )
