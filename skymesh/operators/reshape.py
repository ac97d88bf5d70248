"""Long and wide forms, static attributes, full grids, joins of cubes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("lat", "lon", "time")


def to_long(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return df.unpivot(list(keys), list(variables), "variable", "value")


def to_wide(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The names are given, so no job has to look for them."""
    return df.groupBy(*keys).pivot("variable", list(variables)).agg(F.first("value", ignorenulls=True))


def with_static(df: DataFrame, static: DataFrame, keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Attributes of a cell, at each of its times."""
    return df.join(static, list(keys), "left")


def full_grid(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All combinations of the axis values of ``dims``: as many rows as the dense cube has cells."""
    return reduce(lambda a, b: a.crossJoin(b), (df.select(d).distinct() for d in dims))


def reindex(df: DataFrame, grid: DataFrame, dims: Sequence[str]) -> DataFrame:
    return grid.join(df, list(dims), "left")


def align(x: DataFrame, y: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return x.join(y, list(keys), "inner")


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All keys of both sides.  A variable of both takes the value that is present; ``conflicts`` counts
    variables with two different ones."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, *(F.col(c).alias(f"{c}__a") if c in shared else F.col(c) for c in a.columns if c not in keys))
    right = b.select(*keys, *(F.col(c).alias(f"{c}__b") if c in shared else F.col(c) for c in b.columns if c not in keys))
    out = left.join(right, list(keys), "full_outer")
    clash = sum((F.coalesce(F.col(f"{c}__a") != F.col(f"{c}__b"), F.lit(False)).cast("int") for c in shared), F.lit(0))
    out = out.withColumn("conflicts", clash)
    names = [*a.columns, *(c for c in b.columns if c not in a.columns)]
    return out.select(*keys, *(F.coalesce(f"{c}__a", f"{c}__b").alias(c) if c in shared else F.col(c) for c in names if c not in keys), "conflicts")


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_explanation(interpreted: DataFrame, data: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Contributions (keys, bias, contributions) and the data they explain as one long table (keys, feature, shap_value,
    feature_value, base_value); the bias is the base."""
    met = interpreted.select(*keys, "bias", "contributions").join(data.select(*keys, *features), list(keys))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("contributions")[i].alias("shap_value"), F.col(f).cast("double").alias("feature_value"), F.col("bias").alias("base_value")) for i, f in enumerate(features)))
    return met.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def explanation_wide(explanation: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return explanation.groupBy(*keys).pivot("feature", list(features)).agg(F.first("shap_value"))
