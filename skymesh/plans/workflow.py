"""From a cube to scored and explained folds, in a fixed order of steps.

load: read, choose variables and rows, replace values, calculated features, daily values, resampling,
thinning, target, scaling.  train: one model for each held-out year.  explain: contributions or Shapley
values of stored folds.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymesh.functions.columns import all_finite, column_of, formula, replace_values
from skymesh.operators import attribution, folds, forest, reshape, select, stats, temporal
from skymesh.sources import tables

log = logging.getLogger(__name__)
CELL = ("lat", "lon")


@dataclass
class Spec:
    """What to load.  ``sections`` as in ``temporal.daily_sections``; ``replace`` maps a variable to
    (low, high, value)."""

    target: str
    globs: Sequence[str] = ()
    variables: Sequence[str] | str = ".*"
    ranges: Mapping[str, Sequence] = field(default_factory=dict)
    month: int | None = None
    drop: Mapping[str, int] = field(default_factory=dict)
    replace: Mapping[str, Sequence] = field(default_factory=dict)
    calc: Mapping[str, str] = field(default_factory=dict)
    sections: Sequence[Mapping] = ()
    days: int | None = None
    how: str = "mean"
    every: tuple[str, int] | None = None
    scale: bool = False
    scale_by: Sequence[str] = ()
    #: variables without a time, which daily values carry along
    static: Sequence[str] = ()


def load(spark: SparkSession, spec: Spec, cube: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The rows (lat, lon, time, features, target) of a specification and the names of the features."""
    df = cube if cube is not None else tables.read_cube(spark, *spec.globs)
    if df is None:
        raise FileNotFoundError(f"no file matches {spec.globs}")
    known = [*df.columns, *spec.calc]
    plain = column_of(spec.target, known) in known
    inputs = [column_of(spec.target, known)] if plain else formula(spec.target, known)[1]
    inputs += [n for text in spec.calc.values() for n in formula(text, known)[1]]
    wanted = [*([spec.variables] if isinstance(spec.variables, str) else spec.variables), *spec.static]
    df = select.select_vars(df, [*wanted, *(n for n in inputs if n in df.columns)])
    for dim, bounds in spec.ranges.items():
        df = select.sel_range(df, dim, bounds)
    if spec.month:
        df = select.sel_month(df, spec.month)
    if spec.drop:
        df = select.drop_date(df, **spec.drop)
    df = df.drop(*select.PARTS)
    for name, (low, high, value) in spec.replace.items():
        df = df.withColumn(name, replace_values(name, low, high, value))
    df = select.with_calculated(df, spec.calc)
    if spec.sections:
        df = temporal.daily_sections(df, spec.sections, static=spec.static).withColumnRenamed("day", "time")
    names = [c for c in df.columns if c not in select.KEYS]
    if spec.days:
        df = temporal.resample(df, spec.days, spec.how, names).withColumnRenamed("bin", "time")
    if spec.every:
        df = temporal.every_nth_dropped(df, *spec.every)
    df = select.with_target(df, spec.target)
    names = [c for c in df.columns if c not in (*select.KEYS, "target")]
    if spec.scale:
        df = stats.zscore(df, names, spec.scale_by)
    return df, names


def train(rows: DataFrame, features: Sequence[str], years: Sequence[int], path: str, run: str, month: str = "all", test: DataFrame | None = None, **params) -> DataFrame:
    """Fits and stores a model and the predictions of each held-out year; the scores of all folds, from what is stored.
    With ``test``, one model of all ``rows`` predicts the rows of another selection, and the fold's year is 0."""
    own, empty = forest.prepare(rows, features)
    if own is None:
        raise ValueError("no complete row")
    _stored_folds(own, [f for f in features if f not in empty], years, path, run, month, test, **params)
    return rescore(own.sparkSession, path, run).filter(F.col("month").cast("string") == month)


def _stored_folds(own: DataFrame, used: Sequence[str], years: Sequence[int], path: str, run: str, month: str, test: DataFrame | None = None, **params) -> None:
    """Models and predictions of prepared rows, stored by fold."""
    own = own.withColumn("year", F.year("time")).cache()
    if test is None:
        folds_ = forest.by_year(own, years, **params)
    else:
        model = forest.estimator(**params).fit(own)
        held = select.drop_incomplete(all_finite(test, [*used, "target"]), used, "target")
        folds_ = [(0, model, model.transform(forest.assemble(held, used)))]
    for year, model, predicted in folds_:
        if predicted.isEmpty():
            log.warning("no row of %s", year)
            continue
        where = {"run": run, "month": month, "fold_year": year, "kind": "test"}
        model.write().overwrite().save(f"{path}/model/run={run}/month={month}/fold_year={year}")
        tables.save_object(predicted.select(*select.KEYS, *used, "target", "predict"), path, "predict", where)
    own.unpersist()


def train_months(spark: SparkSession, spec: Spec, months: str, years: Sequence[int], path: str, run: str, cube: DataFrame | None = None, at_once: int = 3, **params) -> DataFrame | None:
    """One run for each calendar month of ``months`` (``1-12``, ``1-12:2``, ``1,3,5``); the scores of all, None if no month has a
    complete row.

    The rows of all months are loaded once and stored by month under ``path``, so the cube is read once and a month's jobs read
    their own part; ``at_once`` months run side by side, each in a scheduler pool of its own.  Resampling, thinning and
    scaling depend on the month's rows alone: with these each month is loaded by itself."""
    wanted = folds.months(months)
    if spec.days or spec.every or spec.scale:
        own = {m: load(spark, replace(spec, month=m), cube) for m in wanted}
    else:
        rows, features = load(spark, replace(spec, month=None), cube)
        place = f"{path}/rows/run={run}"
        tables.overwrite_partitions(rows.withColumn("part_month", F.month("time")).filter(F.col("part_month").isin(wanted)).repartition("part_month", F.year("time")), place, "part_month")
        stored = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, part_month int").parquet(place)
        own = {m: (stored.filter(F.col("part_month") == m).drop("part_month"), features) for m in wanted}

    def job(m: int):
        def of_month() -> bool:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", tables.MONTHS[m - 1])
            rows, features = own[m]
            ready, empty = forest.prepare(rows, features)
            if ready is None:
                log.warning("no complete row in month %s", m)
                return False
            _stored_folds(ready, [f for f in features if f not in empty], years, path, run, tables.MONTHS[m - 1], **params)
            return True

        return of_month

    done = [tables.MONTHS[m - 1] for m, ok in zip(wanted, forest.side_by_side(spark, [job(m) for m in wanted], at_once), strict=True) if ok]
    return rescore(spark, path, run).filter(F.col("month").cast("string").isin(done)) if done else None


def resampled_points(rows: DataFrame, features: Sequence[str], days: int = 3) -> DataFrame:
    """Means over ``days`` of the rows to be explained, without cells that lack a value and, if the number of times is no
    multiple of ``days``, without the last bin."""
    bins = temporal.without_short_end(temporal.resample(rows, days, "mean", features), rows, days)
    return bins.withColumn("time", F.col("bin").cast("timestamp_ntz")).drop("bin").dropna("any")


def explain(spark: SparkSession, path: str, run: str, features: Sequence[str], mode: str = "shap", work: str | None = None, regions: Mapping | None = None, days: int | None = None) -> DataFrame:
    """Explanations of all stored folds of a run: (keys, fold_year, feature, shap_value, feature_value,
    base_value).  ``mode``: shap (exact) or path (differences along the path).  With ``days``, of means over as many.

    Each fold is explained and written by itself, under ``work`` or ``path``: neither a plan nor the driver holds the forests of
    all folds."""
    if mode not in ("shap", "path"):
        raise ValueError(f"unknown mode {mode!r}")
    stored = tables.load_objects(spark, path, ["predict"], run=run)["predict"]
    if stored is None:
        raise FileNotFoundError(f"no predictions of {run} in {path}")
    keys, places, folder = list(select.KEYS), [], f"{work or path}/explained-{uuid.uuid4().hex}"
    for r in tables.folds_of(stored).collect():
        rows = stored.filter((F.col("fold_year") == r.fold_year) & (F.col("month") == r.month)).dropna("any")
        if regions:
            rows = select.sel_regions(rows, regions)
        rows = resampled_points(rows, features, days) if days else rows
        rows = forest.assemble(rows.select(*keys, *features), features)
        model = tables.load_objects(spark, path, ["model"], run=run, month=r.month, fold_year=r.fold_year)["model"]
        nodes = attribution.node_table(model, f"{work or path}/nodes-{run}-{r.month}-{r.fold_year}")
        if mode == "shap":
            one = attribution.tree_shap(rows, nodes, features, keys)
        else:
            got = attribution.interpret_rows(rows, nodes, features, keys)
            one = reshape.to_explanation(got, rows, features, keys)
        places.append(f"{folder}/{r.month}-{r.fold_year}")
        one.withColumn("fold_year", F.lit(r.fold_year)).write.parquet(places[-1])
    return spark.read.parquet(*places) if places else None


def rescore(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Scores of the stored predictions of a run, fold by fold, in one aggregation."""
    return stats.scores(tables.load_objects(spark, path, ["predict"], run=run)["predict"], by=["month", "fold_year"])
