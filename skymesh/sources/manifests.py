"""What to fetch, what is new, what went wrong."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skymesh.sources.tables import overwrite_partitions

log = logging.getLogger(__name__)
LOG = "input string, fingerprint string, rows bigint, status string, message string, at bigint"


def plan(series: DataFrame, networks: DataFrame | None, stations: DataFrame | None, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Series of the networks and stations (None: all) whose id isn't there yet, unless all are wanted."""
    out = series
    if networks is not None:
        out = out.join(networks, "network_name", "left_semi")
    if stations is not None:
        out = out.join(stations, "station_id", "left_semi")
    return out if overwrite else out.join(existing, "id", "left_anti")


def pending(inputs: DataFrame, outputs: DataFrame, key: str, regenerate: bool = False) -> DataFrame:
    return inputs if regenerate else inputs.join(outputs.select(key), key, "left_anti")


def error_report(errors: DataFrame) -> DataFrame:
    """Errors numbered inside their parameter, with the parameter's number of errors."""
    own = Window.partitionBy("parameter")
    return errors.select("parameter", F.row_number().over(own.orderBy("id")).alias("no"), "id", "message", F.count(F.lit(1)).over(own).alias("n_errors"))


# -- a log of what was written ----------------------------------------------------------------------
def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """(input, fingerprint) of files: their path, and their length and time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(F.col("path").alias("input"), F.concat_ws("-", "length", F.unix_micros("modificationTime")).alias("fingerprint"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a log; none if it isn't there yet."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each input, and how many it has."""
    last = F.max_by(F.struct("fingerprint", "rows", "status", "message", "at"), "at").alias("last")
    return entries(spark, path).groupBy("input").agg(last, F.count(F.lit(1)).alias("entries")).select("input", "last.*", "entries")


def unwritten(inputs: DataFrame, spark: SparkSession, path: str, regenerate: bool = False) -> DataFrame:
    """The inputs (input, fingerprint) without a successful entry of their present fingerprint."""
    if regenerate:
        return inputs
    done = state(spark, path).filter("status = 'ok'").select("input", F.col("fingerprint").alias("known"))
    return inputs.join(done, "input", "left").filter("known is null or known <> fingerprint").select(*inputs.columns)


def refresh(spark: SparkSession, inputs: DataFrame, process: Callable[[str], DataFrame], out: str, path: str, regenerate: bool = False) -> DataFrame:
    """Writes what ``process`` gives for each unwritten input as the partition ``input`` of ``out``, and logs it; the entries of this
    run.

    The entry follows the partition: if a run ends between the two, the input stays unwritten and the next run replaces its
    partition, so each output is there once.  An input that fails is logged with its error, and stays unwritten too."""
    run = []
    for r in unwritten(inputs, spark, path, regenerate).orderBy("input").collect():  # names of inputs, as a listing has them
        try:
            own = process(r["input"]).withColumn("input", F.lit(r["input"]))
            overwrite_partitions(own, out, "input")
            rows, status, message = spark.read.parquet(out).filter(F.col("input") == r["input"]).count(), "ok", None
        except Exception as e:  # whatever a source raises: the others go on
            log.warning("%s: %s", r["input"], e)
            rows, status, message = 0, "failed", str(e).splitlines()[0][:500] if str(e) else type(e).__name__
        entry = spark.createDataFrame([(r["input"], r["fingerprint"], rows, status, message, time.time_ns())], LOG)
        entry.coalesce(1).write.mode("append").parquet(path)
        run.append(r["input"])
    return state(spark, path).filter(F.col("input").isin(run)) if run else state(spark, path).limit(0)
