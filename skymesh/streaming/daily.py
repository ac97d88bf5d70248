"""Daily values and grid cells of an unbounded stream of samples, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.functions.columns import edge_index, seconds_of_day


def daily(stream: DataFrame, rule: Sequence[int], variables: Sequence[str], late: str = "1 day", keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """As ``temporal.daily`` with two hours in UTC; a day is final once the watermark has passed it.
    ``time`` is a timestamp (with zone UTC), as watermarks need one."""
    at = seconds_of_day(F.col("time"))
    own = stream.withWatermark("time", late).filter(at.between(rule[0] * 3600, rule[1] * 3600))
    out = own.groupBy(*keys, F.window("time", "1 day").alias("w")).agg(*(F.avg(v).alias(v) for v in variables))
    return out.select(*keys, F.to_date("w.start").alias("day"), *variables)


def grid_counts(stream: DataFrame, lats: Sequence[float], lons: Sequence[float], late: str = "1 day", value: str = "value") -> DataFrame:
    """Number and mean of the observations of each day and cell (bin numbers as in ``grid``)."""
    i, j = edge_index(F.col("lat"), [*lats, 90.0]), edge_index(F.col("lon"), [-180.0, *lons])
    own = stream.withWatermark("time", late).withColumns({"lat_i": i, "lon_i": j}).filter("lat_i is not null and lon_i is not null")
    out = own.groupBy("lat_i", "lon_i", F.window("time", "1 day").alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.to_date("w.start").alias("day"), "lat_i", "lon_i", "n", "mean")
