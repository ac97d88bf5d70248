"""Scaling, counts, scores, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def zscore(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation, over all rows or by group; of ``fit_on`` if given.
    Null where the deviation is zero."""
    source = fit_on if fit_on is not None else df
    facts = source.groupBy(*by).agg(*(f(v).alias(f"__{k}_{v}") for v in variables for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(facts, list(by), "left") if by else df.crossJoin(F.broadcast(facts))
    return out.select(*(c for c in df.columns if c not in variables), *(F.try_divide(F.col(v) - F.col(f"__m_{v}"), F.col(f"__s_{v}")).alias(v) for v in variables))


def non_null_counts(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row for each variable: its number of present values, and whether there is none."""
    got = df.agg(*(F.count(F.col(f"`{v}`")).alias(v) for v in variables))
    return got.unpivot([], list(variables), "variable", "n").withColumn("empty", F.col("n") == 0)


def time_mean(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in variables))


def scores(df: DataFrame, y: str = "target", p: str = "predict", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error, root mean square error, R2 and Pearson's r, in one aggregation."""
    y, p = F.col(y), F.col(p)
    residual = (y - p) * (y - p)
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        F.sqrt(F.avg(residual)).alias("rmse"),
        (1 - F.try_divide(F.sum(residual), F.var_pop(y) * F.count(y))).alias("r2"),
        F.corr(y, p).alias("r"),
        F.count(y).alias("n"),
    )
