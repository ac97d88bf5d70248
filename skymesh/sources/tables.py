"""Reading cubes, station records and stored runs; writing by month, by object, by fold."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from skymesh.functions.columns import finite_or_null, plain_name
from skymesh.operators.select import TILE, interleaved, tile_of

log = logging.getLogger(__name__)

STATION = T.StructType(
    [
        T.StructField("datetime", T.ArrayType(T.StringType())),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.StructType([T.StructField("network_name", T.StringType()), T.StructField("station_id", T.StringType()), T.StructField("station_lon", T.DoubleType()), T.StructField("station_lat", T.DoubleType())])),
    ]
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def plain_columns(df: DataFrame) -> DataFrame:
    """``df`` with plain column names; two names with one plain form are an error."""
    names = [plain_name(c) for c in df.columns]
    if twice := {c for c, n in zip(df.columns, names, strict=True) if names.count(n) > 1}:
        raise ValueError(f"these columns have the same plain name: {sorted(twice)}")
    return df.toDF(*names)


def read_source(spark: SparkSession, *path: str) -> DataFrame | None:
    """The files that match (``{a,b}`` and ``[1-5]`` included) one after the other, with plain column names and
    missing values as null; None if no file matches."""
    try:
        df = spark.read.option("mergeSchema", "true").parquet(*path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    df = plain_columns(df)
    return df.withColumns({c: finite_or_null(c) for c, t in df.dtypes if t in ("double", "float")})


def _stacked(sources: Sequence[DataFrame], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = list(dict.fromkeys(c for s in sources for c in s.columns if c not in keys))
    types = {c: t for s in reversed(sources) for c, t in s.dtypes}
    every = None
    for i, s in enumerate(sources):
        one = s.select(*keys, *(F.col(c) if c in s.columns else F.lit(None).cast(types[c]).alias(c) for c in names), F.lit(i).alias("__from"))
        every = one if every is None else every.unionByName(one)
    return every, names


def combine_by_coords(sources: Sequence[DataFrame], keys: Sequence[str] = ("lat", "lon", "time"), conflicts: str = "raise") -> DataFrame:
    """Sources aligned by their coordinates, whatever their variables: a row for each coordinate that any of them has, in one
    grouping.  Sources without a time are attributes of the cell, at each of its times.

    Two different values of a variable at one coordinate are an error that names them (``conflicts="raise"``), or the
    first source's, in order, is taken (``"first"``); a missing value is no conflict."""
    if conflicts not in ("raise", "first"):
        raise ValueError(f"unknown way with conflicts {conflicts!r}")
    moving, static = ([s for s in sources if ("time" in s.columns) == t] for t in (True, False))
    if not moving:
        moving, static, keys = static, [], [k for k in keys if k != "time"]

    def aligned(own: list[DataFrame], keys: Sequence[str]) -> DataFrame:
        if len(own) == 1:
            return own[0]
        every, names = _stacked(own, keys)
        have = lambda c: F.when(F.col(c).isNotNull(), F.col("__from"))
        if conflicts == "first":
            return every.groupBy(*keys).agg(*(F.min_by(c, have(c)).alias(c) for c in names))
        met = every.groupBy(*keys).agg(*(F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in names))
        place = F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), F.col(k).cast("string")) for k in keys))
        told = lambda c: F.concat(F.lit(f"sources differ in {c} at "), place, F.lit(": "), F.col(c)["a"].cast("string"), F.lit(" and "), F.col(c)["b"].cast("string"))
        return met.select(*keys, *(F.when(F.col(c)["a"] == F.col(c)["b"], F.col(c)["a"]).when(F.col(c)["a"].isNotNull(), F.raise_error(told(c)).cast(dict(every.dtypes)[c])).alias(c) for c in names))

    out = aligned(moving, keys)
    if static:
        cell = [k for k in keys if k in static[0].columns]
        out = out.join(aligned(static, cell), cell, "left")
    return out


def conflicts_of(sources: Sequence[DataFrame], keys: Sequence[str] = ("lat", "lon", "time")) -> DataFrame:
    """(keys, variable, low, high, n_values): where sources with these keys have different values of a variable."""
    every, names = _stacked(sources, keys)
    long = every.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select(*keys, "x.*").filter("value is not null")
    met = long.groupBy(*keys, "variable").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("value").alias("n_values"))
    return met.filter("n_values > 1")


def read_cube(spark: SparkSession, *globs: str, disjoint: bool = False, conflicts: str = "raise") -> DataFrame | None:
    """The cube that several globs make: each is a source, and sources are aligned by coordinates, with differing values treated as
    ``combine_by_coords`` says.  A file that several globs match is read once.  With ``disjoint``, sources with the same variables
    are known to share no coordinate (as years don't) and follow one another without a grouping.  None, with a log entry, if
    no file matches."""
    seen: set[str] = set()
    sources = []
    for g in globs:
        own = read_source(spark, g)
        if own is None:
            continue
        files = set(own.inputFiles())
        if again := files & seen:
            rest = sorted(files - seen)
            log.info("%s files of %s were read already", len(again), g)
            own = read_source(spark, *rest) if rest else None
        seen |= files
        if own is not None:
            sources.append(own)
    if not sources:
        log.error("no file matches %s", globs)
        return None
    if disjoint:
        groups: dict[tuple, DataFrame] = {}
        for s in sources:
            key = tuple(sorted(s.columns))
            groups[key] = groups[key].unionByName(s) if key in groups else s
        sources = list(groups.values())
    return combine_by_coords(sources, conflicts=conflicts) if len(sources) > 1 else sources[0]


def read_station_json(spark: SparkSession, path: str, values: Sequence[str] = ("mean",)) -> tuple[DataFrame, DataFrame]:
    """Station rows (network, station, lon, lat, datetime, values) of files with one document each, and the
    number of files, of those that can't be parsed, and of those with two keys or fewer."""
    files = station_files(spark, path, values)
    report = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "unparsed").alias("unparsed"), F.count_if(F.col("status") == "short").alias("short"))
    rows = files.filter("status = 'read'").select("d.metadata", F.explode("r").alias("r")).filter(F.col("r.datetime").isNotNull())
    return rows.select(F.col("metadata.network_name").alias("network"), F.col("metadata.station_id").alias("station"), F.col("metadata.station_lon").alias("lon"), F.col("metadata.station_lat").alias("lat"), "r.datetime", *(f"r.{v}" for v in values)), report


def station_files(spark: SparkSession, path: str, values: Sequence[str] = ("mean",)) -> DataFrame:
    """A row for each station file: file, status (read, short, unparsed), its rows, and how many values and dates of it can't be read.

    Values are read one by one: what is no number (``NaN`` is none either) becomes null, and a row without a readable date is left
    out, each without taking the rest of its file along."""
    text = T.ArrayType(T.StringType())
    fields = [T.StructField("datetime", text), STATION["metadata"], *(T.StructField(v, text) for v in values)]
    raw = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).option("wholetext", "true").text(path)
    # literals that JSON doesn't know are numbers' names outside of strings: between a bracket, comma or colon and another
    plain = F.regexp_replace("value", r"(?<=[\[,:])(\s*)(-?Infinity|NaN)(?=\s*[\],}])", "$1null")
    parsed = raw.select(F.input_file_name().alias("file"), F.from_json(plain, T.StructType(fields)).alias("d"), F.size(F.json_object_keys(plain)).alias("keys"))
    bad = F.col("keys").isNull() | (F.col("keys") < 0)
    status = F.when(bad, "unparsed").when(F.col("keys") <= 2, "short").otherwise("read")
    zipped = F.arrays_zip("d.datetime", *(f"d.{v}" for v in values))
    number = lambda x, v: F.when(F.abs(x[v].try_cast("double")) < float("inf"), x[v].try_cast("double")).alias(v)  # noqa: E731  NaN isn't less
    row = lambda x: F.struct(x["datetime"].try_cast("timestamp_ntz").alias("datetime"), *(number(x, v) for v in values))
    lost = lambda x: F.aggregate(F.array(*(F.when(x[v].isNotNull() & ~F.upper(x[v]).isin("NAN", "NULL") & x[v].try_cast("double").isNull(), 1).otherwise(0) for v in values)), F.lit(0), lambda a, b: a + b)
    own = parsed.select("file", "d", status.alias("status"), F.coalesce(zipped, F.array()).alias("z")).withColumn("r", F.transform("z", row))
    dates = F.size(F.filter("r", lambda x: x["datetime"].isNull()))
    return own.select("file", "status", "d", "r", F.size("r").alias("rows"), F.aggregate(F.transform("z", lost), F.lit(0), lambda a, b: a + b).alias("lost_values"), dates.alias("lost_dates"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def station_table(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"station_lat": "lat", "station_lon": "lon", "time": "date"})


def merge_variables(long: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """(keys, variable, value) rows of many files as one row for each key."""
    return long.groupBy(*keys).pivot("variable", list(variables)).agg(F.first("value", ignorenulls=True))


def variable_of_file(path=None):
    """The variable that a file name holds: what follows its first ``_``, parts joined by ``/``."""
    name = F.regexp_extract(F.input_file_name() if path is None else path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.array_join(F.slice(F.split(name, "_"), 2, 1000), "/")


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` by partition; of what is there, only its own partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def consolidate(spark: SparkSession, folders: Mapping[str, str], out: str, rename: Mapping[str, str] | None = None) -> None:
    """The files of each variable's folder as one partition of a table; a second run replaces them."""
    for name, path in folders.items():
        new = (rename or {}).get(name, name)
        own = spark.read.parquet(path).withColumnRenamed(name, "value").withColumn("variable", F.lit(new))
        overwrite_partitions(own, out, "variable")


def save_by_month(df: DataFrame, path: str, time: str = "time") -> None:
    """One partition for each month that ``df`` has; other months stay as they are.  Columns of the table named year or
    month are kept as they are and the partitions called by other names."""
    year, month = ("year_of", "month_of") if {"year", "month"} & set(df.columns) else ("year", "month")
    own = df.withColumns({year: F.year(time), month: F.month(time)})
    overwrite_partitions(own.repartition(year, month), path, year, month)


def save_cube(df: DataFrame, path: str, degrees: float = TILE) -> None:
    """A cube (lat, lon, time, variables) by year, month and tile of ``degrees``, each in the Z-order of its cells.  What is read
    back has the partition columns, by which ``sel_month``, ``sel_range`` and ``sel_regions`` leave out files; inside a
    file, cells that are near each other share row groups, whose bounds the reader checks."""
    cell = interleaved(F.floor((F.col("lat") + 90) * 4).cast("int"), F.floor(F.pmod(F.col("lon"), F.lit(360.0)) * 4).cast("int"), 11)
    own = df.withColumns({"part_year": F.year("time"), "part_month": F.month("time"), "part_tile": tile_of(F.col("lat"), F.col("lon"), degrees), "__cell": cell})
    own = own.repartition("part_year", "part_month", "part_tile").sortWithinPartitions("part_year", "part_month", "part_tile", "__cell", "time").drop("__cell")
    overwrite_partitions(own, path, "part_year", "part_month", "part_tile")


def save_object(df: DataFrame, path: str, name: str, where: Mapping[str, object], grid: DataFrame | None = None, dims: Sequence[str] = ("lat", "lon"), wide: Sequence[str] | None = None) -> None:
    """An object of a run, in the partition that run, month, fold and kind name, on the full grid if it is
    given, in order of longitude.  With ``wide``, a long object (keys, variable, value) becomes these columns."""
    if wide is not None:
        keys = [c for c in df.columns if c not in ("variable", "value")]
        df = merge_variables(df, keys, wide)
    out = grid.join(df, list(dims), "left") if grid is not None else df
    at = "/".join(f"{k}={v}" for k, v in where.items())
    out.sortWithinPartitions("lon").write.mode("overwrite").parquet(f"{path}/{name}/{at}")


def save_objects(path: str, where: Mapping[str, object], enabled: Sequence[str], **objects: DataFrame | None) -> list[str]:
    """The enabled objects that are there; their names."""
    done = []
    for name in enabled:
        if objects.get(name) is None:
            log.warning("there is no %s to save", name)
            continue
        save_object(objects[name], path, name, where)
        done.append(name)
    return done


def load_objects(spark: SparkSession, path: str, names: Sequence[str], **where) -> dict[str, DataFrame | RandomForestRegressionModel | None]:
    """The stored objects of a run, by partition; ``model`` is the fitted model of the fold that ``where`` names.
    None for what isn't there."""
    out: dict = {}
    for name in names:
        try:
            if name == "model":
                out[name] = RandomForestRegressionModel.load(f"{path}/model/" + "/".join(f"{k}={v}" for k, v in where.items() if k != "kind"))
                continue
            df = spark.read.parquet(f"{path}/{name}")
            for k, v in where.items():
                df = df.filter(F.col(k).cast("string") == str(v))
            out[name] = df
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            out[name] = None
        except Py4JJavaError as e:
            if name != "model" or "InvalidInputException" not in str(e):
                raise
            out[name] = None
    return out


def folds_of(outputs: DataFrame) -> DataFrame:
    """Runs with outputs: run, month and fold year, months in calendar order."""
    number = F.coalesce(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.substring("month", 1, 3))), F.lit(0))
    return outputs.select("run", "month", "fold_year").distinct().withColumn("month_no", number).orderBy("run", "month_no", "fold_year")
