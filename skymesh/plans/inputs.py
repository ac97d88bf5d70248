"""The given tables as cubes, site series, station observations and training rows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ["gas_click", "gas_view", "gas_purchase", "gas_signup", "gas_error"]
LATS = [float(v) for v in range(-80, 81, 20)]
LONS = [float(v) for v in range(-150, 181, 30)]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(ts: str):
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def cube_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gridded hourly cube of five variables from the event stream."""
    e = table(spark, sf_dir, "events")
    lat, lon = (F.col("user_id") % 5) * 20 - 40, (F.floor(F.col("user_id") / 5) % 4) * 90 + 15
    values = (F.avg(F.when(F.col("event_type") == v.removeprefix("gas_"), F.col("value"))).alias(v) for v in VARIABLES)
    return e.groupBy(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), hour_of("ts").alias("time")).agg(*values)


CUBE = """cube as (select cast((user_id % 5) * 20 - 40 as double) lat, cast((user_id // 5 % 4) * 90 + 15 as double) lon,
 date_trunc('hour', ts) as time, """ + ", ".join(f"avg(value) filter (event_type = '{v.removeprefix('gas_')}') {v}" for v in VARIABLES) + " from events group by 1, 2, 3)"


def site_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("site"), hour_of("ts").alias("ts")).agg(F.avg("value").alias("value"))


SITES = "sites as (select event_type site, date_trunc('hour', ts) ts, avg(value) as value from events group by 1, 2)"


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(s.alias("station"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("value"), ((s * 37) % 180 - 90 + 0.5).cast("double").alias("lat"), ((s * 53) % 360 - 180 + 0.5).cast("double").alias("lon"))


OBS = "obs as (select l_suppkey station, cast(l_shipdate as date) date, l_quantity as value, cast((l_suppkey * 37) % 180 - 90 + 0.5 as double) lat, cast((l_suppkey * 53) % 360 - 180 + 0.5 as double) lon from lineitem)"


def ml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: five features, a target that is a function of three of them, year and month."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size"))
    target = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(*ROW_KEY, *FEATURES, target.alias("target"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))


ML = "ml as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, cast(p_size as double) p_size, l_extendedprice * (1 - l_discount) * (1 + l_tax) target, year(l_shipdate) as year, month(l_shipdate) as month from lineitem join part on l_partkey = p_partkey)"

#: (tree, node, value, cover, feature, threshold, left, right)
TINY_FOREST = [
    (0, 0, 50.0, 100.0, 0, 25.0, 1, 2), (0, 1, 30.0, 50.0, -1, None, -1, -1), (0, 2, 70.0, 50.0, 1, 0.05, 3, 4),
    (0, 3, 60.0, 30.0, -1, None, -1, -1), (0, 4, 80.0, 20.0, -1, None, -1, -1),
    (1, 0, 48.0, 100.0, 1, 0.03, 1, 2), (1, 1, 40.0, 40.0, -1, None, -1, -1), (1, 2, 56.0, 60.0, 0, 10.0, 3, 4),
    (1, 3, 44.0, 12.0, -1, None, -1, -1), (1, 4, 58.0, 48.0, -1, None, -1, -1),
]


def tiny_forest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TINY_FOREST, "tree int, node int, value double, cover double, feature int, threshold double, left int, right int")
