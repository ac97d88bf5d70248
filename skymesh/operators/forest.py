"""Random forests: preparation, folds, prediction, quantiles, importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skymesh.functions.columns import all_finite
from skymesh.operators.select import drop_incomplete
from skymesh.operators.stats import non_null_counts

#: estimators by name, with what all of them are given unless told otherwise
KINDS = {"RandomForestRegressor": RandomForestRegressor, "GradientBoostingRegressor": GBTRegressor}


def estimator(kind: str = "RandomForestRegressor", **params):
    if kind not in KINDS:
        raise ValueError(f"unknown estimator {kind!r}; there are {sorted(KINDS)}")
    given = {"featureSubsetStrategy": "all", "seed": 0, "labelCol": "target", "featuresCol": "features", "predictionCol": "predict"}
    if kind == "RandomForestRegressor":
        given |= {"numTrees": 100, "maxDepth": 30, "leafCol": "leaf"}
    return KINDS[kind](**given | params)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def spread(df: DataFrame, rows: int, least: int = 20_000, most: int = 1_000_000) -> DataFrame:
    """``df``, of about so many ``rows``, dealt evenly to all cores, at least ``least`` rows to each.

    Training costs far more than reading, and a small table comes from few files: one core would do all of it.  A table of over
    ``most`` rows for each core stays as it was read, as its files give every core enough; so what is exchanged is bounded."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = min(cores, -(-rows // least))
    return df.repartition(n) if n > 1 and rows <= most * cores else df


def bounded(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """``df``, of about so many ``rows``, ``spread``, or dealt to tasks of at most ``most`` rows: a fit keeps its rows by partition, and
    reads whole partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = -(-rows // (most * cores)) * cores
    return spread(df, rows) if n <= cores else df.repartition(n)


def prepare(df: DataFrame, features: Sequence[str], target: str = "target", deal: Callable = bounded) -> tuple[DataFrame | None, list[str]]:
    """Finite, complete rows with a feature vector, spread over the cores and bounded in each task, and the features without any value (left out); no
    frame if no row is left.  With ``deal=spread`` a large table isn't exchanged, for what reads its rows as a stream."""
    own = all_finite(df, [*features, target])
    counts = non_null_counts(own, features).collect()
    empty = [r.variable for r in counts if r.empty]
    used = [f for f in features if f not in empty]
    out = drop_incomplete(own, used, target)
    return (None, empty) if not used or out.isEmpty() else (assemble(deal(out, min(r.n for r in counts if not r.empty)), used), empty)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], at_once: int = 4) -> Iterator:
    """What the jobs give, in their order, ``at_once`` of them running at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        yield from pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs])


def by_year(df: DataFrame, years: Sequence[int], year: str = "year", at_once: int = 4, **params):
    """(year, model, predictions) with each year held out once; the vectors are made once, folds are fitted side by side."""
    fit = lambda y: lambda: estimator(**params).fit(df.filter(F.col(year) != y))
    for y, model in zip(years, side_by_side(df.sparkSession, [fit(y) for y in years], at_once), strict=True):
        yield y, model, model.transform(df.filter(F.col(year) == y)).withColumn("fold", F.lit(y))


def best_model(df: DataFrame, grid: dict[str, Sequence], fold: str = "fold", parallel: int = 2, **params):
    """The best parameters of a grid by RMSE over the folds, and a row for each combination."""
    base = estimator(**params)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(base.getParam(name), list(values))
    maps = builder.build()
    search = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol="target", predictionCol="predict"), foldCol=fold, numFolds=df.agg(F.max(fold)).first()[0] + 1, parallelism=parallel)
    found = search.fit(df)
    rows = [(*(m[base.getParam(n)] for n in grid), float(v)) for m, v in zip(maps, found.avgMetrics, strict=True)]
    return found.bestModel, df.sparkSession.createDataFrame(rows, [*grid, "rmse"])


def model_importance(model: RandomForestRegressionModel, spark, features: Sequence[str]) -> DataFrame:
    """Impurity importance and its population deviation over the trees."""
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    total = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(total[i]), float(each[:, i].std())) for i, f in enumerate(features)], "feature string, importance double, std double")


def interval_quantiles(percents: Sequence[float]) -> list[float]:
    """The lower and upper quantiles of central intervals, rounded, sorted and each once; 0 is the median."""
    out = set()
    for p in percents:
        low = 0.5 if p == 0 else round((1 - p / 100) / 2, 3)
        out |= {low, round(1 - low, 3)}
    return sorted(out)


def leaves(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row for each row and tree: the leaf that it reaches."""
    return model.transform(df).select(*keep, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))


def leaf_arrays(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``leaves``, the leaf that the row reaches in each tree."""
    return model.transform(df).select(*keep, vector_to_array("leaf").cast("array<int>").alias("leaves"))


def _reached_in_bin(samples: pa.Table, wanted: pa.Table) -> pa.Table:
    """The quantiles that fall into one bin: of each wanted one, the samples of its leaves are merged up to it."""
    y, c = samples["y"].to_numpy(), samples["c"].to_numpy()
    order = np.argsort(y, kind="stable")
    y, c = y[order], c[order]
    lists = lambda t, name: t[name].combine_chunks().flatten().to_numpy()
    leaf = lists(samples, "leaves").reshape(len(y), -1)[order] if len(y) else np.zeros((0, 1), np.int32)
    found = np.full(wanted.num_rows, np.nan)
    if len(y) and wanted.num_rows:
        kinds, sizes = (lists(wanted, n).reshape(wanted.num_rows, -1) for n in ("leaves", "sizes"))
        places = np.argsort(leaf, 0, kind="stable")  # of each tree, the samples by leaf, then target
        edges = [[np.searchsorted(leaf[places[:, t], t], kinds[:, t], side) for side in ("left", "right")] for t in range(leaf.shape[1])]
        for r, (q, before, whole) in enumerate(zip(*(wanted[n].to_numpy() for n in ("q", "before", "whole")), strict=True)):
            own = [places[a[r] : b[r], t] for t, (a, b) in enumerate(edges)]
            at = np.concatenate(own)
            weight = c[at] / np.repeat(sizes[r], [len(o) for o in own])
            up = np.argsort(at, kind="stable")
            reached = (before + np.cumsum(weight[up])) / whole >= q - 1e-9
            # the last target of the bin reaches the quantile, whatever the order of the sums rounds to
            found[r] = y[at[up[reached.argmax() if reached.any() else -1]]]
    return pa.table({"leaves": wanted["leaves"], "i": wanted["i"], "y": pa.array(found)})


def quantiles(samples: DataFrame, rows: DataFrame, keys: Sequence[str], at: Sequence[float], bins: int = 256) -> DataFrame:
    """Quantiles of the training targets in the leaves that a row reaches.

    ``samples`` (leaves, target) of the training rows, ``rows`` (keys, leaves), with a leaf for each tree.  A sample weighs
    1 / (trees x size of its leaf); a quantile is the least target whose cumulative weight reaches it.
    Rows that reach the same leaves share their quantiles.  Samples are counted by tree, leaf and bin of the target, which finds the
    bin of each quantile; then each sample goes once to its bin, where the samples of the leaves asked for are merged up to the
    quantile, so the result is exact.  A bin has at most about 50,000 samples; equal ones are counted."""
    y = samples.schema["target"].dataType
    own = samples.select(F.col("target").cast("double").alias("y"), F.col("leaves").cast("array<int>").alias("leaves")).filter("y is not null")
    rows = rows.withColumn("leaves", F.col("leaves").cast("array<int>"))
    bins = max(bins, own.count() // 50_000) if bins > 1 else bins
    edges = sorted(set(own.approxQuantile("y", [i / bins for i in range(1, bins)], 0.25 / bins))) if bins > 1 else []
    own = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="y", outputCol="bin", handleInvalid="keep").transform(own) if edges else own.withColumn("bin", F.lit(0.0))
    cells = own.select("bin", F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf", "bin").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.withColumn("size", F.sum("c").over(Window.partitionBy("tree", "leaf")))  # a row for each bin

    kinds = rows.select("leaves").distinct().select("leaves", F.posexplode("leaves").alias("tree", "leaf"))
    met = kinds.join(cells, ["tree", "leaf"]).groupBy("leaves", "bin").agg(F.sum(F.col("c") / F.col("size")).alias("w"), F.collect_set(F.struct("tree", "size")).alias("has"))
    to_bin = Window.partitionBy("leaves").orderBy("bin")
    upto = F.sum("w").over(to_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum("w").over(to_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = met.select("leaves", "bin", "has", upto.alias("upto"), before.alias("before"), F.sum("w").over(Window.partitionBy("leaves")).alias("whole"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at))))
    part = part.withColumn("x", wanted).select("leaves", "bin", "has", "before", "whole", "upto", "x.*")
    part = part.filter((F.col("upto") / F.col("whole") >= F.col("q") - 1e-9) & ((F.col("before") == 0) | (F.col("before") / F.col("whole") < F.col("q") - 1e-9)))
    # a leaf without samples in this bin gives none, so its size isn't needed
    size = F.transform("leaves", lambda _, t: F.coalesce(F.element_at(F.map_from_entries("has"), t), F.lit(1)).cast("double"))
    part = part.select("bin", "leaves", "i", "q", "before", "whole", size.alias("sizes"))

    equal = own.groupBy(F.col("bin").alias("__bin"), "y", "leaves").agg(F.count(F.lit(1)).cast("double").alias("c"))
    found = equal.groupBy("__bin").cogroup(part.groupBy("bin")).applyInArrow(_reached_in_bin, "leaves array<int>, i int, y double")
    found = found.groupBy("leaves").agg(*(F.max(F.when(F.col("i") == i, F.col("y"))).cast(y).alias("q_" + f"{q:g}".replace(".", "_")) for i, q in enumerate(at)))
    return rows.select(*keys, "leaves").join(found, "leaves").drop("leaves")
