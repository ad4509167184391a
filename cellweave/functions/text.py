"""Name handling for genes and barcodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.orderstats import position_in_group


def extract_field(text: str | Column, field: int | str = 1, delim: str = "_") -> Column:
    """Field ``field`` of a delimited string, or several ("1,3") joined again."""
    text = F.col(text) if isinstance(text, str) else text
    quoted = re.escape(delim)
    parts = F.split(F.regexp_replace(text, f"{quoted}$", ""), quoted)
    wanted = [int(f) for f in str(field).split(",")]
    picked = [F.get(parts, F.lit(f - 1)) for f in wanted]
    return picked[0] if len(picked) == 1 else F.concat_ws(delim, *picked)


def strip_common_suffix(df: DataFrame, name: str, suffix: str = "-1") -> DataFrame:
    """Cut the name at its first dash, but only if every name ends in ``suffix``."""
    every = df.agg(F.bool_and(F.col(name).endswith(suffix)).alias("every")).scalar()
    return df.withColumn(name, F.when(every, extract_field(name, 1, suffix[0])).otherwise(F.col(name)))


def zero_padded(prefix: str, number: Column, total: Column) -> Column:
    """``prefix_007``: the width is that of the largest number."""
    width = (F.floor(F.log10(total)) + 1).cast("int")
    return F.concat(F.lit(f"{prefix}_"), F.lpad(number.cast("string"), width, F.lit("0")))


def make_unique(df: DataFrame, name: str, index: str, out: str = "unique_name") -> DataFrame:
    """First use of a name stays, later uses get ``.1``, ``.2``, ...

    Numbers already taken by an original name (``x.1`` next to ``x``) are skipped.
    """
    numbered = position_in_group(df, [name], index, "_use")
    taken = (
        df.select(
            F.regexp_extract(name, r"^(.*)\.([1-9][0-9]{0,17})$", 1).alias(name),
            F.regexp_extract(name, r"^(.*)\.([1-9][0-9]{0,17})$", 2).alias("_number"),
        )
        .where(F.col("_number") != "")
        .groupBy(name)
        .agg(F.array_sort(F.collect_set(F.col("_number").cast("long"))).alias("_taken"))
    )
    first_free = F.aggregate(
        F.coalesce(F.col("_taken"), F.array().cast("array<bigint>")),
        (F.col("_use") - 1).cast("long"),
        lambda n, t: F.when(t <= n, n + 1).otherwise(n),
    )
    unique = F.when(F.col("_use") == 1, F.col(name)).otherwise(F.concat_ws(".", F.col(name), first_free.cast("string")))
    return numbered.join(taken, name, "left").withColumn(out, unique).select(*df.columns, out)
