"""Exact order statistics that never sort one large group in one task.

* ``exact_quantiles``: a sketch brackets each wanted rank, one more pass counts
  what lies below the bracket and keeps only the few values inside it.
* ``running_counts``: within-group counts below each distinct value. Groups with
  more distinct values than a task should sort are cut into value ranges.
* ``midranks``, ``bh_adjust``, ``position_in_group`` build on the same idea.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import materialize

SMALL_ROWS = 1_000_000
SPLIT_ROWS = 10_000_000
FAN_OUT = 64
MAX_BROADCAST_GROUPS = 100_000


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    small_rows: int | None = None,
) -> DataFrame:
    """Interpolated quantiles (R type 7) as column ``q array<double>``.

    Pass a written table: it is read more than once. Up to ``small_rows`` rows the
    built-in exact percentile holds its values in one task. Beyond that, any
    group may hold most of the rows. The sketch errs by at most n/accuracy ranks, so the bracket holds
    a bounded share of the rows, and ranks just outside it are still answered
    exactly by the neighbouring extreme.
    """
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if base.count() <= (SMALL_ROWS if small_rows is None else small_rows):
        return base.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    margin = 2.0 / accuracy
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]
    summary = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", low, accuracy).alias("_lo"),
        F.percentile_approx("_v", high, accuracy).alias("_hi"),
    )
    spot = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.col("_lo")[i].alias("lo"),
            F.col("_hi")[i].alias("hi"),
            F.floor(s).alias("k"),
            (s - F.floor(s)).alias("frac"),
        )
        for i, s in enumerate(spot)
    ])
    summary = summary.select(*by, brackets.alias("_brackets"))
    if by:
        summary = materialize(summary, "brackets")
        few = summary.count() <= MAX_BROADCAST_GROUPS
        base = base.join(F.broadcast(summary) if few else summary, by)
        opened = base.select(*by, "_v", F.explode("_brackets").alias("b"))
    else:
        opened = base.select("_v", F.explode(summary.scalar()).alias("b"))

    zone = F.when(F.col("_v") < F.col("b.lo"), 0).when(F.col("_v") <= F.col("b.hi"), 1).otherwise(2)
    counted = (
        opened.select(*by, "b.i", "b.k", "b.frac", "_v", zone.alias("zone"))
        .groupBy(*by, "i", "k", "frac", "zone", F.when(F.col("zone") == 1, F.col("_v")).alias("inside"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"))
    )
    order = Window.partitionBy(*by, "i").orderBy("zone", "inside").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("n").over(order)).withColumn("start", F.col("upto") - F.col("n"))

    def at(rank):
        found = (
            F.when(F.col("zone") == 1, F.col("inside"))
            .when((F.col("zone") == 0) & (rank == F.col("upto") - 1), F.col("highest"))
            .when((F.col("zone") == 2) & (rank == F.col("start")), F.col("lowest"))
            .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        )
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("upto")), found))

    picked = counted.groupBy(*by, "i", "frac").agg(at(F.col("k")).alias("x0"), at(F.col("k") + 1).alias("x1"))
    q = F.col("x0") + F.col("frac") * (F.coalesce("x1", "x0") - F.col("x0"))
    return (
        picked.select(*by, "i", q.alias("_q"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("i", "_q"))).alias("_all"))
        .select(*by, F.transform("_all", lambda s: s["_q"]).alias("q"))
    )


def running_counts(
    freq: DataFrame,
    by: Sequence[str],
    value: str,
    count: str = "n",
    split_rows: int | None = None,
) -> DataFrame:
    """Add ``below`` (weight of smaller values in the group) and ``slice``.

    ``freq`` has one row per (``by``, ``value``), so ties are already folded.
    Groups above ``split_rows`` distinct values are cut into ranges by their
    own approximate quantiles, and each range is ordered in its own task.
    """
    by = list(by)
    split_rows = split_rows or SPLIT_ROWS
    freq = materialize(freq, "freq")
    big = freq.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > split_rows)
    earlier = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(count).over(earlier), F.lit(0))
    if big.isEmpty():
        return freq.withColumn("slice", F.lit(0)).withColumn("below", below)

    cuts = (
        freq.join(big.select(*by), by, "left_semi")
        .groupBy(*by)
        .agg(F.percentile_approx(value, [i / FAN_OUT for i in range(1, FAN_OUT)], 100 * FAN_OUT).alias("_cuts"))
    )
    # At most rows/split_rows big groups, each with FAN_OUT - 1 cuts.
    tagged = freq.join(F.broadcast(cuts), by, "left").withColumn(
        "slice",
        F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value)))),
    )
    lower = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.where(F.col("_cuts").isNotNull())
        .groupBy(*by, "slice")
        .agg(F.sum(count).alias("_n"))
        .select(*by, "slice", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"))
    )
    return (
        tagged.drop("_cuts")
        .withColumn("_below", below)
        .join(F.broadcast(offsets), [*by, "slice"], "left")
        .withColumn("below", F.col("_below") + F.coalesce("_offset", F.lit(0)))
        .drop("_below", "_offset")
    )


def midranks(df: DataFrame, by: Sequence[str], value: str, split_rows: int | None = None) -> DataFrame:
    """One row per (``by``, ``value``) with tie count ``n`` and average rank ``rank``."""
    freq = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counted = running_counts(freq, by, value, split_rows=split_rows)
    return counted.withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0).drop("slice")


def bh_adjust(df: DataFrame, by: Sequence[str], p: str, q: str = "qvalue", split_rows: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each group; NULL stays NULL.

    The adjusted value is the smallest ``p * n / rank`` among equal or larger p,
    taken first inside a value range and then across the later ranges.
    """
    by = list(by)
    freq = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"))
    counted = running_counts(freq, by, p, split_rows=split_rows)
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_total"))
    counted = counted.join(totals, by).withColumn(
        "_raw", F.col(p) * F.col("_total") / (F.col("below") + F.col("n"))
    )
    later = Window.partitionBy(*by, "slice").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(*by).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    across = (
        counted.groupBy(*by, "slice")
        .agg(F.min("_raw").alias("_low"))
        .select(*by, "slice", F.min("_low").over(beyond).alias("_beyond"))
    )
    adjusted = (
        counted.withColumn("_q", F.min("_raw").over(later))
        .join(across, [*by, "slice"])
        .select(*by, p, F.least(F.lit(1.0), F.col("_q"), F.col("_beyond")).alias(q))
    )
    return df.join(adjusted, [*by, p], "left")


def position_in_group(
    df: DataFrame, by: Sequence[str], index: str, out: str = "position", width: int = 1_000_000
) -> DataFrame:
    """1-based position by a dense integer ``index`` within each group.

    The index range is cut into blocks of ``width``, so a name shared by a third
    of all rows is numbered by many tasks.
    """
    by = list(by)
    blocked = df.withColumn("_block", F.floor(F.col(index) / F.lit(width)))
    lower = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_block", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"))
    )
    inner = Window.partitionBy(*by, "_block").orderBy(index)
    return (
        blocked.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*by, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop("_block", "_rn", "_offset")
    )
