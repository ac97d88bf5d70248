"""Station observations on a model grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.functions.columns import edge_index

METRICS = {
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_pop(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def match_to_grid(obs: DataFrame, lats: Sequence[float], lons: Sequence[float], metrics: Sequence[str], value: str = "value", tag: str = "obs", centre: bool = False) -> DataFrame:
    """Metrics of each date and cell, in one aggregation.  A cell is labelled by its lower latitude edge and
    its upper longitude edge (or by its centre); points outside the grid are left out.  Axes may be
    given in either direction."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    lat_edges, lon_edges = [*sorted(lats), 90.0], [-180.0, *sorted(lons)]
    i, j = edge_index(F.col("lat"), lat_edges), edge_index(F.col("lon"), lon_edges)
    inside = obs.select("date", value, i.alias("lat_i"), j.alias("lon_i")).filter("lat_i is not null and lon_i is not null")
    out = inside.groupBy("date", "lat_i", "lon_i").agg(*(METRICS[m](value).alias(f"{tag}_{m}") for m in metrics))
    label = lambda edges, k, side: F.element_at(F.array(*(F.lit(float(v)) for v in (((a + b) / 2 if centre else (a, b)[side]) for a, b in zip(edges, edges[1:], strict=False)))), F.col(k) + 1)
    return out.select("date", label(lat_edges, "lat_i", 0).alias("lat"), label(lon_edges, "lon_i", 1).alias("lon"), *(f"{tag}_{m}" for m in metrics))


def dense(matched: DataFrame, dates: DataFrame, lats: Sequence[float], lons: Sequence[float], zero: Sequence[str] = ()) -> DataFrame:
    """Every date and cell; the columns ``zero`` (counts and sums) are 0 where nothing was matched."""
    cell = dates.select("date").distinct()
    for name, values in (("lat", lats), ("lon", lons)):
        cell = cell.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    return cell.join(matched, ["date", "lat", "lon"], "left").fillna(0, subset=list(zero))
