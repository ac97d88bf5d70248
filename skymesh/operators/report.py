"""Tables behind plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymesh.operators.stats import time_mean


def importance_bars(importance: DataFrame, permuted: DataFrame | None = None, top: int = 20) -> DataFrame:
    """The most important features, as parts of the greatest, with permutation values in the same order."""
    best = importance.agg(F.max("importance").alias("__max"))
    out = importance.crossJoin(F.broadcast(best)).select("feature", F.try_divide("importance", "__max").alias("importance"), F.try_divide("std", "__max").alias("std"))
    if permuted is not None:
        out = out.join(permuted.select("feature", F.col("importance").alias("permutation"), F.col("std").alias("permutation_std")), "feature", "left")
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def residual_maps(df: DataFrame, keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Time means of truth and prediction, their difference, and the common range of the colours."""
    maps = time_mean(df, ["target", "predict"], keys).withColumn("residual", F.col("target") - F.col("predict"))
    ends = maps.agg(F.min(F.least("target", "predict")).alias("low"), F.max(F.greatest("target", "predict")).alias("high"))
    return maps.crossJoin(F.broadcast(ends))


def density(df: DataFrame, low: float, high: float, bins: int, x: str = "target", y: str = "predict") -> DataFrame:
    """Counts on a square grid from ``low`` to ``high``, the last bins closed."""
    width = (high - low) / bins
    at = lambda c: F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("bigint")
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    return df.filter(inside).groupBy(at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def _corners(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Each row at the four nodes of a grid around it, with weights that add up to 1."""
    u, v = F.col(x) / step, F.col(y) / step
    i, j = F.floor(u), F.floor(v)
    fu, fv = u - i, v - j
    nodes = F.array(*(F.struct((i + a).alias("i"), (j + b).alias("j"), ((fu if a else 1 - fu) * (fv if b else 1 - fv)).alias("w")) for a in (0, 1) for b in (0, 1)))
    return df.withColumn("__x", F.explode(F.filter(nodes, lambda n: n["w"] > 0))).select("*", "__x.*").drop("__x")


def kernel_density(df: DataFrame, keys: Sequence[str], bandwidth: float, x: str = "target", y: str = "predict", fine: int = 8, cut: int = 4) -> DataFrame:
    """(keys, density): at each point, the mean of Gaussian kernels of ``bandwidth`` around all points.

    Points are dealt to the nodes of a grid of ``bandwidth / fine``, nodes are smoothed along each axis up to ``cut`` bandwidths
    (two groupings, whose size depends on the nodes in use, not on pairs of points), and points read their nodes.  In
    units of a kernel's height the error is at most 1 / (2 fine^2) + 2 exp(-cut^2 / 2); points on nodes have the second
    part only.  Points that lack a coordinate are left out."""
    step = bandwidth / fine
    own = _corners(df.select(*keys, F.col(x).cast("double").alias("__u"), F.col(y).cast("double").alias("__v")).dropna("any", subset=["__u", "__v"]), "__u", "__v", step)
    nodes = own.groupBy("i", "j").agg(F.sum("w").alias("w"))
    offsets = F.explode(F.array(*(F.struct(F.lit(o).cast("bigint").alias("o"), F.lit(math.exp(-((o / fine) ** 2) / 2)).alias("k")) for o in range(-cut * fine, cut * fine + 1))))
    smooth = nodes.withColumn("n", offsets).groupBy((F.col("i") + F.col("n.o")).alias("i"), "j").agg(F.sum(F.col("w") * F.col("n.k")).alias("w"))
    smooth = smooth.join(nodes.select("i").distinct(), "i", "left_semi")
    smooth = smooth.withColumn("n", offsets).groupBy("i", (F.col("j") + F.col("n.o")).alias("j")).agg(F.sum(F.col("w") * F.col("n.k")).alias("s"))
    total = nodes.agg(F.sum("w").alias("__n"))  # one row
    met = own.join(smooth, ["i", "j"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("s")).alias("s"))
    return met.crossJoin(F.broadcast(total)).select(*keys, (F.col("s") / F.col("__n") / (2 * math.pi * bandwidth**2)).alias("density"))


def axis_limits(df: DataFrame, x: str = "target", y: str = "predict") -> DataFrame:
    """Joint extremes, moved out by a twentieth of their size."""
    e = df.agg(F.min(F.least(x, y)).alias("a"), F.max(F.greatest(x, y)).alias("b"))
    return e.select((F.col("a") - F.abs("a") * 0.05).alias("low"), (F.col("b") + F.abs("b") * 0.05).alias("high"))


def shap_summary(explanation: DataFrame) -> DataFrame:
    """Mean absolute value of each feature and its rank."""
    mean = explanation.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs"), F.avg("shap_value").alias("mean"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))  # a row for each feature


def shap_dependence(explanation: DataFrame, feature: str, colour: str, keys: Sequence[str]) -> DataFrame:
    """A feature's value and Shapley value with another feature's value, in one aggregation by row."""
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return explanation.groupBy(*keys).agg(pick(feature, "feature_value").alias("x"), pick(feature, "shap_value").alias("shap"), pick(colour, "feature_value").alias("colour"))


def waterfall(explanation: DataFrame, keys: Sequence[str], most: int = 10) -> DataFrame:
    """From the base value to the prediction by descending size of the contribution; those beyond
    ``most - 1`` are put together as ``other``."""
    own = Window.partitionBy(*keys)
    size = Window.partitionBy(*keys).orderBy(F.desc(F.abs("shap_value")), "feature")
    ranked = explanation.withColumn("rank", F.row_number().over(size)).withColumn("of", F.count(F.lit(1)).over(own))
    rest = (F.col("of") > most) & (F.col("rank") >= most)
    short = ranked.groupBy(*keys, F.when(rest, most).otherwise(F.col("rank")).alias("rank")).agg(F.when(F.max(rest.cast("int")) == 1, "other").otherwise(F.max("feature")).alias("feature"), F.sum("shap_value").alias("shap_value"), F.max("base_value").alias("base_value"))
    run = Window.partitionBy(*keys).orderBy("rank")
    return short.withColumn("upto", F.col("base_value") + F.sum("shap_value").over(run))


def waterfall_rows(explained: DataFrame, features: Sequence[str], keys: Sequence[str], most: int = 10) -> DataFrame:
    """``waterfall`` of rows with ``shap_values`` (in the order of ``features``) and ``base_value``: each row is sorted inside itself, so nothing is
    exchanged."""
    pairs = F.arrays_zip(F.col("shap_values").alias("v"), F.array(*(F.lit(f) for f in features)).alias("feature"))
    sized = F.array_sort(F.transform(pairs, lambda x: F.struct((-F.abs(x["v"])).alias("size"), x["feature"].alias("feature"), x["v"].alias("v"))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["v"])
    if len(features) > most:
        rest = F.struct(F.lit(0.0).alias("size"), F.lit("other").alias("feature"), total(F.slice("__s", most, len(features))).alias("v"))
        shown = F.concat(F.slice("__s", 1, most - 1), F.array(rest))
    else:
        shown = F.col("__s")
    steps = F.transform("__s", lambda x, i: F.struct(x["feature"].alias("feature"), x["v"].alias("shap_value"), (F.col("base_value") + total(F.slice("__s", F.lit(1), i + 1))).alias("upto")))
    own = explained.select(*keys, "base_value", sized.alias("__s")).select(*keys, "base_value", shown.alias("__s"))
    long = own.select(*keys, "base_value", F.posexplode(steps).alias("at", "x"))
    return long.select(*keys, (F.col("at") + 1).alias("rank"), "x.feature", "x.shap_value", "base_value", "x.upto")


def mean_explanation(explanation: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return explanation.join(points, list(keys), "left_semi").groupBy("feature").agg(F.avg("shap_value").alias("shap_value"), F.avg("feature_value").alias("feature_value"), F.avg("base_value").alias("base_value"))
