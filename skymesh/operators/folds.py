"""Folds: by year, in contiguous blocks, and reports of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_sides(df: DataFrame, year: str = "year") -> DataFrame:
    """One row for each held-out year: the number of rows and the years of either side."""
    per = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    held = per.select(F.col(year).alias("fold"))
    side = F.when(F.col("fold") == F.col(year), "test").otherwise("train").alias("side")
    pairs = held.crossJoin(F.broadcast(per)).select("fold", year, "n", side)  # years x years
    return pairs.groupBy("fold", "side").agg(F.sum("n").alias("n_rows"), F.array_join(F.sort_array(F.collect_set(F.col(year).cast("string"))), ",").alias("years"))


def block_folds(df: DataFrame, k: int, order: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """Contiguous folds in stack order; the first ``n % k`` folds are one larger.

    ``bins`` are leading columns of ``order``: rows are numbered inside each of their combinations, and
    the combinations' sizes give the offsets, so no window takes all rows."""
    sizes = df.groupBy(*bins).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*bins, (F.sum("__n").over(Window.orderBy(*bins)) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    number = F.row_number().over(Window.partitionBy(*bins).orderBy(*order)) - 1
    at = df.withColumn("__at", number).join(before, list(bins)).withColumn("__at", F.col("__at") + F.col("__before"))
    small, large = F.floor(F.col("__all") / k), F.col("__all") % k
    edge = large * (small + 1)
    fold = F.when(F.col("__at") < edge, F.floor(F.col("__at") / (small + 1))).otherwise(large + F.floor(F.try_divide(F.col("__at") - edge, small)))
    return at.withColumn("fold", fold.cast("int")).drop("__at", "__before", "__all")


def shuffled_folds(df: DataFrame, k: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Folds of a random order of the rows; the first ``n % k`` folds are one larger.

    The order is that of an MD5 of the seed and the keys (then the keys themselves), so it depends neither on partitions nor
    on the order of the input.  Rows are ranked inside bins of the hash, whose sizes give the offsets."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys)).cast("binary"))
    own = df.withColumn("__hash", text).withColumn("__bin", F.substring("__hash", 1, 4))
    return block_folds(own, k, ["__hash", *keys], ["__bin"]).drop("__hash", "__bin")


def months(text: str) -> list[int]:
    """``1-12``, ``1-12:2`` or ``1,3,5`` as a list."""
    out: list[int] = []
    for part in text.split(","):
        span, _, step = part.partition(":")
        low, _, high = span.partition("-")
        out += range(int(low), int(high or low) + 1, int(step or 1))
    return out
