"""The registered queries and, for each that SQL can express, the SQL that gives the same rows.

Values are rounded on both sides, after aggregation only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skymesh.functions import columns as fn
from skymesh.operators import attribution, folds, forest, grid, growth, report, reshape, select, stats, temporal, trees
from skymesh.plans import workflow
from skymesh.plans.inputs import CUBE, FEATURES, LATS, LONS, ML, OBS, ROW_KEY, SITES, VARIABLES, cube_hourly, ml_rows, site_hourly, station_obs, table, tiny_forest
from skymesh.sources import manifests, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
V = ", ".join(VARIABLES)
OFFSET = "cast(floor(((case when lon >= 180 then lon - 360 else lon end) + 7.5) / 15) as integer)"
SECONDS = "(hour(time) * 3600 + minute(time) * 60 + second(time))"
BOX = {"lat": (-40, 20), "lon": (15, 195)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def r6(names: str, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n.strip()}, 6) {n.strip()}" for n in names.split(","))


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one if local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skymesh-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- choice of rows and columns -------------------------------------------------------------------
@query(f"with {CUBE}, d as (select lat, lon, cast(time as date) as day, avg(gas_click) c, avg(gas_view) w from cube where lat between -40 and 20 and lon between 15 and 195 and {SECONDS} between 28800 and 54000 group by 1, 2, 3) select lat, lon, count(*) n, round(avg(c - w), 6) mean, round(stddev_pop(c - w), 6) std, round(min(c - w), 6) low, round(max(c - w), 6) high from d where c - w is not null group by 1, 2")
def daily_target_summary(spark, sf_dir):
    cube = select.sel_regions(cube_hourly(spark, sf_dir), {"box": BOX}, dropna=False)
    days = temporal.daily(cube, (8, 15), ["gas_click", "gas_view"])
    own = select.drop_incomplete(select.with_target(days, "(gas_click) - (gas_view)"), ["target"])
    return rounded(own.groupBy("lat", "lon").agg(F.count("target").alias("n"), F.avg("target").alias("mean"), F.stddev_pop("target").alias("std"), F.min("target").alias("low"), F.max("target").alias("high")))


@query(f"with {CUBE} select lat, lon, time, {r6(V)} from cube where lat between -40 and 0 and lon between 15 and 105")
def sel_region_box(spark, sf_dir):
    return rounded(select.sel_range(select.sel_range(cube_hourly(spark, sf_dir), "lat", (0, -40)), "lon", (15, 105)))


@query(f"with {CUBE} select lat, lon, time, round(gas_click, 6) gas_click from cube where lon = 105")
def sel_value_vars(spark, sf_dir):
    return rounded(select.select_vars(select.sel_value(cube_hourly(spark, sf_dir), "lon", 105.0), ["gas_click"]))


@query(f"with {CUBE} select lat, lon, time, {r6('gas_view, gas_purchase, gas_error')} from cube")
def select_vars_pattern(spark, sf_dir):
    return rounded(select.select_vars(cube_hourly(spark, sf_dir), "gas_(?!click|signup).*"))


@query(f"with {ML} select count(*) n, round(avg(target), 4) mean from ml where month = 3")
def sel_month(spark, sf_dir):
    own = select.sel_month(ml_rows(spark, sf_dir), 3, "l_shipdate")
    return rounded(own.agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean")), 4)


@query(f"with {ML} select cast(year as integer) as year, count(*) n from ml where not (month = 2 and day(l_shipdate) = 29) group by 1")
def drop_date(spark, sf_dir):
    return select.drop_date(ml_rows(spark, sf_dir), month=2, day=29, time="l_shipdate").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CUBE}, ok as (select distinct lat, lon from cube where gas_purchase > 250) select lat, lon, time, {r6(V)} from cube semi join ok using (lat, lon)")
def sel_pairs_semi(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return rounded(select.sel_cells(cube, cube.filter("gas_purchase > 250")))


@query(f"with {CUBE}, ok as (select distinct lat, lon from cube where gas_purchase > 250) select lat, lon, time, {r6(V)} from cube anti join ok using (lat, lon)")
def sel_pairs_anti(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return rounded(select.sel_cells(cube, cube.filter("gas_purchase > 250"), remove=True))


@query(f"with {CUBE}, ok as (select distinct lat, lon from cube where gas_error is not null) select lat, lon, count(*) n from cube semi join ok using (lat, lon) group by 1, 2")
def use_locations_of(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return select.sel_cells(cube, select.cells_with(cube, "gas_error")).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CUBE} select lat, lon, time, {r6(V)} from cube where ((lat between 0 and 40 and lon between 15 and 105) or (lat between -20 and 20 and lon between 105 and 195)) and gas_click is not null and gas_view is not null and gas_purchase is not null and gas_signup is not null and gas_error is not null")
def predict_regions(spark, sf_dir):
    return rounded(select.sel_regions(cube_hourly(spark, sf_dir), {"a": {"lat": (0, 40), "lon": (15, 105)}, "b": {"lat": (-20, 20), "lon": (105, 195)}}))


@query(f"with {CUBE} select lat, lon, time, round(case when gas_click between 20 and 60 then 0 else gas_click end, 6) zeroed, round(case when gas_view between 20 and 60 or gas_view is null then null else gas_view end, 6) cleared from cube")
def replace_vals(spark, sf_dir):
    return rounded(cube_hourly(spark, sf_dir).select("lat", "lon", "time", fn.replace_values("gas_click", 20, 60, 0.0).alias("zeroed"), fn.replace_values("gas_view", 20, 60).alias("cleared")))


@query(f"with {CUBE} select lat, lon, time, round(gas_purchase, 6) gas_purchase, round(gas_signup, 6) gas_signup, round(gas_error, 6) gas_error, round(gas_click - 2 * gas_view, 6) target from cube")
def calc_expr_target(spark, sf_dir):
    return rounded(select.with_target(cube_hourly(spark, sf_dir), "(gas_click) - 2 * (gas_view)"))


@query(f"with {CUBE} select lat, lon, time, round(gas_click / nullif(gas_view, 0), 6) ratio, round(gas_click / nullif(gas_view, 0) + gas_error, 6) total from cube")
def calc_features(spark, sf_dir):
    own = select.with_calculated(cube_hourly(spark, sf_dir), {"ratio": "(gas_click) / (gas_view)", "total": "(ratio) + (gas_error)"})
    return rounded(own.select("lat", "lon", "time", "ratio", "total"))


@query(f"with {CUBE} select lat, lon, time, round(coalesce(gas_click, gas_view), 6) combined from cube")
def combine_first(spark, sf_dir):
    return rounded(cube_hourly(spark, sf_dir).select("lat", "lon", "time", F.coalesce("gas_click", "gas_view").alias("combined")))


@query("select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then null else round(value, 6) end x from events")
def finite_or_null(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return rounded(fn.all_finite(e.select("event_id", x.alias("x")), ["x"]))


@query(f"with {CUBE} select lat, lon, time, round(gas_click, 6) gas_click, round(gas_view, 6) gas_view from cube where gas_click is not null and gas_view is not null")
def drop_incomplete(spark, sf_dir):
    return rounded(select.drop_incomplete(cube_hourly(spark, sf_dir).select("lat", "lon", "time", "gas_click", "gas_view"), ["gas_click"], "gas_view"))


@query(f"with {CUBE} " + " union all ".join(f"select '{v}' variable, count({v}) n, count({v}) = 0 as empty from cube" for v in VARIABLES))
def null_feature_counts(spark, sf_dir):
    return stats.non_null_counts(cube_hourly(spark, sf_dir), VARIABLES)


@query(f"with {CUBE} select distinct lon, case when lon >= 180 then lon - 360 else lon end signed, case when (case when lon >= 180 then lon - 360 else lon end) < 0 then (case when lon >= 180 then lon - 360 else lon end) + 360 else lon end east, {OFFSET} off from cube")
def lon_wrap(spark, sf_dir):
    own = cube_hourly(spark, sf_dir).select("lon").distinct().withColumn("signed", fn.to_signed(F.col("lon")))
    return own.select("lon", "signed", fn.to_east(F.col("signed")).alias("east"), fn.utc_offset_hours(F.col("lon")).alias("off"))


@query(f"with {CUBE} select time, round(gas_click, 6) gas_click from cube where lat = (select lat from cube order by abs(lat - 7), lat limit 1) and lon = (select lon from cube order by abs(lon - 120), lon limit 1)")
def nearest_point_series(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    lat, lon = (select.nearest_coord(cube, d, v).first()[0] for d, v in (("lat", 7.0), ("lon", 120.0)))
    return rounded(select.point_series(cube, lat, lon, "gas_click"))


# -- reshape and joins ----------------------------------------------------------------------------
@query(f"with {CUBE} " + " union all ".join(f"select lat, lon, time, '{v}' variable, round({v}, 6) as value from cube" for v in VARIABLES))
def unpivot_long(spark, sf_dir):
    return rounded(reshape.to_long(cube_hourly(spark, sf_dir), VARIABLES))


@query(f"with {CUBE} select lat, lon, time, {r6(V)} from cube")
def pivot_wide(spark, sf_dir):
    return rounded(reshape.to_wide(reshape.to_long(cube_hourly(spark, sf_dir), VARIABLES), VARIABLES))


@query(f"with {CUBE}, s as (select cast((n_nationkey % 5) * 20 - 40 as double) lat, count(*) nations, max(n_name) label from nation group by 1) select cube.lat, lon, time, round(gas_click, 6) gas_click, nations, label from cube left join s on cube.lat = s.lat")
def broadcast_static(spark, sf_dir):
    static = table(spark, sf_dir, "nation").groupBy(((F.col("n_nationkey") % 5) * 20 - 40).cast("double").alias("lat")).agg(F.count(F.lit(1)).alias("nations"), F.max("n_name").alias("label"))
    return rounded(reshape.with_static(cube_hourly(spark, sf_dir).select("lat", "lon", "time", "gas_click"), static, ["lat"]))


@query(f"with {CUBE}, d as (select lat, lon, cast(time as date) as day, avg(gas_error) gas_error from cube where gas_error is not null group by 1, 2, 3), g as (select * from (select distinct lat from cube), (select distinct lon from cube), (select distinct cast(time as date) as day from cube)) select g.lat, g.lon, g.day, round(gas_error, 6) gas_error from g left join d on g.lat = d.lat and g.lon = d.lon and g.day = d.day")
def reindex_grid(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir).withColumn("day", F.to_date("time"))
    days = cube.filter("gas_error is not null").groupBy("lat", "lon", "day").agg(F.avg("gas_error").alias("gas_error"))
    return rounded(reshape.reindex(days, reshape.full_grid(cube, ["lat", "lon", "day"]), ["lat", "lon", "day"]))


@query(f"with {CUBE} select lat, lon, time, round(a.gas_click, 6) gas_click, round(b.gas_view, 6) gas_view from (select * from cube where gas_click is not null) a join (select * from cube where gas_view is not null) b using (lat, lon, time)")
def align_inner(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return rounded(reshape.align(cube.filter("gas_click is not null").select("lat", "lon", "time", "gas_click"), cube.filter("gas_view is not null").select("lat", "lon", "time", "gas_view")))


@query(f"with {CUBE}, a as (select lat, lon, time, gas_click, gas_error from cube where lat <= 0), b as (select lat, lon, time, gas_view, gas_error from cube where lat >= 0) select coalesce(a.lat, b.lat) lat, coalesce(a.lon, b.lon) lon, coalesce(a.time, b.time) as time, round(gas_click, 6) gas_click, round(coalesce(a.gas_error, b.gas_error), 6) gas_error, round(gas_view, 6) gas_view, cast(0 as integer) conflicts from a full join b on a.lat = b.lat and a.lon = b.lon and a.time = b.time")
def merge_outer(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return rounded(reshape.merge(cube.filter("lat <= 0").select("lat", "lon", "time", "gas_click", "gas_error"), cube.filter("lat >= 0").select("lat", "lon", "time", "gas_view", "gas_error")))


@query(f"with {CUBE} select lat, lon, time, round(gas_click, 6) gas_click, cast(null as double) gas_view from cube where lat < 0 union all select lat, lon, time, round(gas_click, 6), round(gas_view, 6) from cube where lat >= 0")
def concat_union(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir)
    return rounded(reshape.concat(cube.filter("lat < 0").select("lat", "lon", "time", "gas_click"), cube.filter("lat >= 0").select("lat", "lon", "time", "gas_click", "gas_view")))


# -- stations on a grid ---------------------------------------------------------------------------
_LAT = "(case " + " ".join(f"when lat < {hi} then {lo}" for lo, hi in zip(LATS, LATS[1:], strict=False)) + f" else {LATS[-1]} end)"
_LON = "(case " + " ".join(f"when lon < {hi} then {hi}" for hi in LONS[:-1]) + f" else {LONS[-1]} end)"
_MATCHED = f"{OBS}, m as (select date, cast({_LAT} as double) lat, cast({_LON} as double) lon, value from obs where lat between -80 and 90 and lon between -180 and 180)"


@query(f"with {_MATCHED} select date, lat, lon, round(avg(value), 6) obs_mean, round(quantile_cont(value, 0.5), 6) obs_median, round(stddev_pop(value), 6) obs_std, round(min(value), 6) obs_min, round(max(value), 6) obs_max from m group by 1, 2, 3")
def match_grid_mean_median_std(spark, sf_dir):
    return rounded(grid.match_to_grid(station_obs(spark, sf_dir), LATS, LONS, ["mean", "median", "std", "min", "max"]))


_AXES = f"(select cast(unnest([{', '.join(map(str, LATS))}]) as double) lat), (select cast(unnest([{', '.join(map(str, LONS))}]) as double) lon)"


@query(f"with {_MATCHED}, g as (select date, lat, lon from (select distinct date from obs), {_AXES}), c as (select date, lat, lon, count(value) obs_count, sum(value) obs_sum from m group by 1, 2, 3) select g.date, g.lat, g.lon, coalesce(obs_count, 0) obs_count, round(coalesce(obs_sum, 0), 6) obs_sum from g left join c on g.date = c.date and g.lat = c.lat and g.lon = c.lon")
def match_grid_count_dense(spark, sf_dir):
    obs = station_obs(spark, sf_dir)
    return rounded(grid.dense(grid.match_to_grid(obs, LATS, LONS, ["count", "sum"]), obs, LATS, LONS, ["obs_count", "obs_sum"]))


@query(f"with {OBS} select date_trunc('month', date)::date as month, count(value) + count(lat) n from obs group by 1")
def month_data_counts(spark, sf_dir):
    return temporal.month_counts(station_obs(spark, sf_dir), ["value", "lat"])


# -- time -----------------------------------------------------------------------------------------
@query(f"with {CUBE} select lat, lon, cast(time as date) as day, " + ", ".join(f"round(avg({v}), 6) {v}" for v in VARIABLES) + f" from cube where {SECONDS} between 28800 and 54000 group by 1, 2, 3")
def daily_range_mean(spark, sf_dir):
    return rounded(temporal.daily(cube_hourly(spark, sf_dir), (8, 15), VARIABLES))


@query(f"with {CUBE} select lat, lon, cast(time as date) as day, {r6(V)} from cube where {SECONDS} = 46800")
def daily_hour_pick(spark, sf_dir):
    return rounded(temporal.daily(cube_hourly(spark, sf_dir), 13, VARIABLES))


_LOCAL = f"(({SECONDS} + {OFFSET} * 3600 + 86400) % 86400)"


@query(f"with {CUBE} select lat, lon, cast(time as date) as day, " + ", ".join(f"round(avg({v}), 6) {v}" for v in VARIABLES) + f" from cube where {_LOCAL} between 28800 and 54000 group by 1, 2, 3")
def daily_local_tz(spark, sf_dir):
    return rounded(temporal.daily(cube_hourly(spark, sf_dir), (8, 15), VARIABLES, local=True))


@query(f"with {CUBE} select lat, lon, cast(time + to_hours({OFFSET}) as date) as day, round(avg(gas_click), 6) gas_click from cube where {_LOCAL} between 28800 and 54000 group by 1, 2, 3")
def daily_local_label(spark, sf_dir):
    return rounded(temporal.daily(cube_hourly(spark, sf_dir), (8, 15), ["gas_click"], local=True, label="local"))


@query(f"with {CUBE} select lat, lon, cast(time as date) as day, round(avg(gas_click) filter ({_LOCAL} between 28800 and 54000), 6) gas_click, round(max(gas_view) filter ({SECONDS} = 46800), 6) gas_view, round(avg(gas_purchase) filter ({SECONDS} between 0 and 82800), 6) gas_purchase, round(avg(gas_signup) filter ({SECONDS} between 0 and 82800), 6) gas_signup from cube group by 1, 2, 3")
def daily_sections(spark, sf_dir):
    sections = [{"vars": ["gas_click"], "time": (8, 15), "local": True}, {"vars": ["gas_view", "not_there"], "time": 13}, {"vars": "gas_(purchase|signup)", "time": (0, 23)}]
    return rounded(temporal.daily_sections(cube_hourly(spark, sf_dir), sections))


_BINS = "f as (select min(cast(time as date)) a, max(cast(time as date)) b from cube), bins as (select cast(unnest(generate_series(a, b, interval {d} day)) as date) bin from f), cells as (select distinct lat, lon from cube)"


@query(f"with {CUBE}, {_BINS.format(d=3)} select cells.lat, cells.lon, bins.bin, round(avg(gas_click), 9) gas_click, round(avg(gas_view), 9) gas_view from cells cross join bins left join cube on cube.lat = cells.lat and cube.lon = cells.lon and cast(time as date) >= bin and cast(time as date) < bin + 3 group by 1, 2, 3")
def resample_3d_mean(spark, sf_dir):
    return rounded(temporal.resample(cube_hourly(spark, sf_dir), 3, "mean", ["gas_click", "gas_view"]), 9)


@query(f"with {CUBE} select lat, lon, last_day(cast(time as date)) bin, count(gas_click) gas_click from cube group by 1, 2, 3")
def resample_month_count(spark, sf_dir):
    return temporal.resample_calendar(cube_hourly(spark, sf_dir), "month", "count", ["gas_click"])


@query(f"with {CUBE}, {_BINS.format(d=7)}, r as (select cells.lat, cells.lon, bins.bin, count(gas_click) gas_click from cells cross join bins left join cube on cube.lat = cells.lat and cube.lon = cells.lon and cast(time as date) >= bin and cast(time as date) < bin + 7 group by 1, 2, 3) select * from r where (select count(distinct cast(time as date)) from cube) % 7 = 0 or bin < (select max(bin) from bins)")
def resample_drop_trailing(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir).withColumn("day", F.to_date("time"))
    return temporal.without_short_end(temporal.resample(cube, 7, "count", ["gas_click"]), cube, 7, "day")


@query(f"with {SITES}, w as (select a.site, cast(a.ts as date) as day, a.ts, avg(b.value) m, count(*) n from sites a join sites b on a.site = b.site and cast(a.ts as date) = cast(b.ts as date) and b.ts >= a.ts and b.ts < a.ts + interval 8 hour group by 1, 2, 3), s as (select *, first_value(n) over (partition by site, day order by ts) need from w), t as (select *, max(case when n <> need then 1 else 0 end) over (partition by site, day order by ts rows unbounded preceding) stopped from s) select site, day, round(max(case when stopped = 0 then m end), 9) mda8 from t group by 1, 2")
def mda8(spark, sf_dir):
    return rounded(temporal.max_daily_mean(site_hourly(spark, sf_dir)), 9)


@query(f"with {SITES}, w as (select site, cast(ts as date) as day, case when count(value) over f = 8 then avg(value) over f end m from sites window f as (partition by site, cast(ts as date) order by ts rows between 7 preceding and current row)) select site, day, round(max(m), 6) rolling8 from w group by 1, 2")
def rolling8_daily_max(spark, sf_dir):
    return rounded(temporal.rolling_daily_max(site_hourly(spark, sf_dir)))


@query(f"with {CUBE}, a as (select time, row_number() over (order by time) n from (select distinct time from cube)) select lat, lon, time, round(gas_click, 6) gas_click from cube semi join (select time from a where n % 5 <> 0) using (time)")
def subsample_every_nth(spark, sf_dir):
    return rounded(temporal.every_nth_dropped(cube_hourly(spark, sf_dir), "time", 5).select("lat", "lon", "time", "gas_click"))


# -- statistics -----------------------------------------------------------------------------------
@query(f"with {CUBE} select lat, lon, time, " + ", ".join(f"round(({v} - avg({v}) over ()) / nullif(stddev_pop({v}) over (), 0), 5) {v}" for v in VARIABLES[:2]) + " from cube")
def zscore(spark, sf_dir):
    return rounded(stats.zscore(cube_hourly(spark, sf_dir).select("lat", "lon", "time", *VARIABLES[:2]), VARIABLES[:2]), 5)


@query(f"with {CUBE} select lat, lon, time, " + ", ".join(f"round(({v} - avg({v}) over (partition by lat)) / nullif(stddev_pop({v}) over (partition by lat), 0), 5) {v}" for v in VARIABLES[:2]) + " from cube")
def zscore_by_lat(spark, sf_dir):
    return rounded(stats.zscore(cube_hourly(spark, sf_dir).select("lat", "lon", "time", *VARIABLES[:2]), VARIABLES[:2], ["lat"]), 5)


@query(f"with {CUBE} select lat, lon, round(avg(gas_click), 6) gas_click, round(avg(gas_view), 6) gas_view from cube group by 1, 2")
def time_mean_map(spark, sf_dir):
    return rounded(stats.time_mean(cube_hourly(spark, sf_dir), VARIABLES[:2]))


_PRED = f"{ML}, p as (select *, l_extendedprice * 0.988 as predict from ml)"


def predicted(spark, sf_dir):
    return ml_rows(spark, sf_dir).withColumn("predict", F.col("l_extendedprice") * 0.988)


@query(f"with {_PRED} select cast(year as integer) as year, round(avg(abs(target - predict) / greatest(abs(target), 2.220446049250313e-16)), 6) mape, round(sqrt(avg((target - predict) * (target - predict))), 4) rmse, round(1 - sum((target - predict) * (target - predict)) / (var_pop(target) * count(*)), 6) r2, round(corr(target, predict), 6) r, count(*) n from p group by 1")
def scores_by_fold(spark, sf_dir):
    return stats.scores(predicted(spark, sf_dir), by=["year"]).select("year", F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("r", 6).alias("r"), "n")


# -- folds ----------------------------------------------------------------------------------------
@query(f"with {ML}, y as (select year as fold, count(*) n from ml group by 1) select cast(a.fold as integer) fold, case when a.fold = b.fold then 'test' else 'train' end side, cast(sum(b.n) as bigint) n_rows, string_agg(cast(b.fold as varchar), ',' order by b.fold) as years from y a cross join y b group by 1, 2")
def group_kfold_report(spark, sf_dir):
    return folds.year_sides(ml_rows(spark, sf_dir))


@query(f"with {ML} select cast(fold as integer) fold, count(*) n, cast(min(l_orderkey) as bigint) first_key, cast(max(l_orderkey) as bigint) last_key from (select l_orderkey, ntile(7) over (order by year, month, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 fold from ml) group by 1")
def kfold_blocks(spark, sf_dir):
    own = folds.block_folds(ml_rows(spark, sf_dir), 7, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["year", "month"])
    return own.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query(f"with {ML} select case when year < 1998 then 'train' else 'test' end side, count(*) n, round(avg(target), 4) mean from ml where year < 1998 or (year >= 2000 and p_size > 25) group by 1")
def external_test_set(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    train, test = rows.filter("year < 1998"), rows.filter("year >= 2000 and p_size > 25")
    own = reshape.concat(train.withColumn("side", F.lit("train")), test.withColumn("side", F.lit("test")))
    return rounded(own.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean")), 4)


# -- sources and manifests ------------------------------------------------------------------------
def series(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("network_name"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("id"), "network_name", F.col("s_name").alias("station_id"), "s_acctbal")


_SERIES = "series as (select s_suppkey id, n_name network_name, s_name station_id, s_acctbal from supplier join nation on s_nationkey = n_nationkey)"


@query(f"with {_SERIES} select id, network_name, station_id from series where network_name in (select n_name from nation where n_regionkey <= 2) and id % 3 <> 0 and s_acctbal >= 0")
def manifest_plan(spark, sf_dir):
    own = series(spark, sf_dir)
    networks = table(spark, sf_dir, "nation").filter("n_regionkey <= 2").select(F.col("n_name").alias("network_name"))
    return manifests.plan(own, networks, own.filter("id % 3 <> 0").select("station_id"), own.filter("s_acctbal < 0").select("id")).select("id", "network_name", "station_id")


@query(f"with {_SERIES} select network_name as parameter, row_number() over (partition by network_name order by id) as no, id, 'balance ' || cast(cast(floor(s_acctbal) as bigint) as varchar) message, count(*) over (partition by network_name) n_errors from series where s_acctbal < 5000")
def error_report(spark, sf_dir):
    bad = series(spark, sf_dir).filter("s_acctbal < 5000")
    errors = bad.select(F.col("network_name").alias("parameter"), "id", F.concat(F.lit("balance "), F.floor("s_acctbal").cast("string")).alias("message"))
    return manifests.error_report(errors).withColumn("no", F.col("no").cast("bigint"))


@query(f"with {_SERIES} select id, network_name from series where not (s_acctbal < 0)")
def incremental_inputs(spark, sf_dir):
    own = series(spark, sf_dir)
    return manifests.pending(own, own.filter("s_acctbal < 0"), "id").select("id", "network_name")


@query(f"with {CUBE} select lat, lon, time, {r6(V)} from cube")
def variable_file_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lat, lon = (F.col("user_id") % 5) * 20 - 40, (F.floor(F.col("user_id") / 5) % 4) * 90 + 15
    long = e.groupBy(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), F.concat(F.lit("gas_"), "event_type").alias("variable")).agg(F.avg("value").alias("value"))
    return rounded(tables.merge_variables(long, ["lat", "lon", "time"], VARIABLES))


@query("select cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month, count(*) n, round(sum(l_quantity), 2) quantity from lineitem group by 1, 2")
def save_by_month_counts(spark, sf_dir):
    path = shared(spark, "by-month")
    tables.save_by_month(table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity"), path, "l_shipdate")
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"with {SITES} select 'net' network, site station, cast(10.5 as double) lon, cast(length(site) as double) lat, ts datetime, round(value, 6) as mean from sites")
def station_json_rows(spark, sf_dir):
    path = shared(spark, "station-json")
    rows = site_hourly(spark, sf_dir).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("r"))
    meta = F.struct(F.lit("net").alias("network_name"), F.col("site").alias("station_id"), F.lit(10.5).alias("station_lon"), F.length("site").cast("double").alias("station_lat"))
    # a file for each station, with arrays of equal length, besides one broken and one with too few keys
    good = rows.select(F.to_json(F.struct(F.transform("r", lambda x: x["ts"].cast("string")).alias("datetime"), F.transform("r", lambda x: x["value"]).alias("mean"), meta.alias("metadata"))).alias("value"))
    others = spark.createDataFrame([('{"datetime": ["2024',), ('{"datetime": [], "mean": []}',)], "value string")
    good.unionByName(others).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    got, _ = tables.read_station_json(spark, path)
    return rounded(got)


# -- models ---------------------------------------------------------------------------------------
_LEVELS = forest.interval_quantiles([95, 90, 50, 0])


@query(f"with {ML} " + " union all ".join(f"select cast(year as integer) as year, cast({q} as double) quantile, round(quantile_cont(target, {q}), 4) as value from ml group by 1" for q in _LEVELS))
def interval_quantiles(spark, sf_dir):
    levels = F.array(*(F.lit(q) for q in _LEVELS))
    bounds = ml_rows(spark, sf_dir).groupBy("year").agg(F.percentile("target", levels).alias("v"))
    return bounds.select("year", F.explode(F.arrays_zip(levels.alias("q"), "v")).alias("x")).select("year", F.col("x.q").alias("quantile"), F.round("x.v", 4).alias("value"))


_T0 = "case when l_quantity <= 25 then 30.0 when l_discount <= 0.05 then 60.0 else 80.0 end"
_T1 = "case when l_discount <= 0.03 then 40.0 when l_quantity <= 10 then 44.0 else 58.0 end"
_C0 = "case when l_quantity <= 25 then -20.0 else 20.0 end"
_C1 = "case when l_discount <= 0.03 then -8.0 else 8.0 end"
TREE = ["l_quantity", "l_discount"]


def interpreted(spark, sf_dir):
    return attribution.interpret_rows(ml_rows(spark, sf_dir), tiny_forest(spark), TREE, ROW_KEY)


def off_balance(got: DataFrame, by: tuple = ()) -> DataFrame:
    """Rows, and those whose prediction isn't bias plus contributions."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    off = F.abs(F.col("predict") - F.col("bias") - total) > 1e-9 * F.greatest(F.lit(1.0), F.abs("predict"))
    return got.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(off.cast("bigint")), F.lit(0)).alias("violations"))


@query(f"with {ML}, t as (select *, {_T0} t0, {_T1} t1, {_C0} c0, {_C1} c1 from ml) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round((t0 + t1) / 2, 6) predict, cast(49 as double) bias, round((c0 + (t1 - 48 - c1)) / 2, 6) contrib_quantity, round(((t0 - 50 - c0) + c1) / 2, 6) contrib_discount from t")
def ti_literal_forest(spark, sf_dir):
    got = interpreted(spark, sf_dir)
    return rounded(got.select(*ROW_KEY, "predict", "bias", F.col("contributions")[0].alias("contrib_quantity"), F.col("contributions")[1].alias("contrib_discount")))


@query("select count(*) n, cast(0 as bigint) violations from lineitem join part on l_partkey = p_partkey")
def ti_additivity(spark, sf_dir):
    return off_balance(interpreted(spark, sf_dir))


@query(f"with {ML}, t as (select *, {_C0} c0, {_T0} t0, {_C1} c1, {_T1} t1 from ml) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'l_quantity' feature, round((c0 + (t1 - 48 - c1)) / 2, 6) shap_value, l_quantity feature_value, cast(49 as double) base_value from t union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'l_discount', round(((t0 - 50 - c0) + c1) / 2, 6), l_discount, 49 from t")
def contributions_to_explanation(spark, sf_dir):
    return rounded(reshape.to_explanation(interpreted(spark, sf_dir), ml_rows(spark, sf_dir), TREE, ROW_KEY))


_LEAF0 = "case when l_quantity <= 25 then 0 when l_discount <= 0.05 then 1 else 2 end"
_LEAF1 = "case when l_discount <= 0.03 then 0 when l_quantity <= 10 then 1 else 2 end"


@query(f"with {ML}, s as (select *, {_LEAF0} a, {_LEAF1} b from ml), tr as (select 0 tree, a leaf, p_size y from s where year < 1998 union all select 1, b, p_size from s where year < 1998), w as (select tree, leaf, y, count(*) / sum(count(*)) over (partition by tree, leaf) w from tr group by 1, 2, 3), te as (select distinct a, b from s where year >= 1998), m as (select a, b, y, sum(w) / 2 w from te join w on (tree = 0 and leaf = a) or (tree = 1 and leaf = b) group by 1, 2, 3), c as (select a, b, y, sum(w) over (partition by a, b order by y) cum from m), q as (select a, b, min(y) filter (cum >= 0.25 - 1e-9) q_0_25, min(y) filter (cum >= 0.5 - 1e-9) q_0_5, min(y) filter (cum >= 0.9 - 1e-9) q_0_9 from c group by 1, 2) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, q_0_25, q_0_5, q_0_9 from s join q using (a, b) where year >= 1998")
def quantile_forest_literal(spark, sf_dir):
    got = attribution.leaves_by_rules(ml_rows(spark, sf_dir), tiny_forest(spark), TREE, [*ROW_KEY, "year", "p_size"])
    samples = got.filter("year < 1998").select("leaves", F.col("p_size").alias("target"))
    return forest.quantiles(samples, got.filter("year >= 1998"), ROW_KEY, [0.25, 0.5, 0.9])


# Shapley values of the two trees with their covers, written out
_V0 = {"": "49.0", "q": "case when l_quantity <= 25 then 30.0 else 68.0 end", "d": "case when l_discount <= 0.05 then 45.0 else 55.0 end", "qd": _T0}
_V1 = {"": "49.12", "q": "case when l_quantity <= 10 then 42.4 else 50.8 end", "d": "case when l_discount <= 0.03 then 40.0 else 55.2 end", "qd": _T1}


def _shapley(v: dict, own: str, other: str) -> str:
    return f"((({v[own]}) - ({v['']})) + (({v['qd']}) - ({v[other]}))) / 2"


_SHAP = f"shap as (select *, ({_shapley(_V0, 'q', 'd')} + {_shapley(_V1, 'q', 'd')}) / 2 sq, ({_shapley(_V0, 'd', 'q')} + {_shapley(_V1, 'd', 'q')}) / 2 sd, (49.0 + 49.12) / 2 base from ml)"


def explained(spark, sf_dir):
    return attribution.tree_shap(ml_rows(spark, sf_dir), tiny_forest(spark), TREE, ROW_KEY)


@query(f"with {ML}, {_SHAP} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'l_quantity' feature, round(sq, 6) shap_value, l_quantity feature_value, round(base, 6) base_value from shap union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'l_discount', round(sd, 6), l_discount, round(base, 6) from shap")
def shap_exact_literal(spark, sf_dir):
    return rounded(explained(spark, sf_dir))


@query(f"with {ML}, {_SHAP}, s as (select 'l_quantity' feature, avg(abs(sq)) mean_abs, avg(sq) m from shap union all select 'l_discount', avg(abs(sd)), avg(sd) from shap) select feature, round(mean_abs, 6) mean_abs, round(m, 6) as mean, cast(row_number() over (order by mean_abs desc, feature) as integer) as rank from s")
def shap_summary(spark, sf_dir):
    return rounded(report.shap_summary(explained(spark, sf_dir)))


@query(f"with {ML}, {_SHAP} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity x, round(sq, 6) shap, l_discount colour from shap")
def shap_dependence(spark, sf_dir):
    return rounded(report.shap_dependence(explained(spark, sf_dir), "l_quantity", "l_discount", ROW_KEY))


@query(f"with {ML}, {_SHAP}, l as (select *, abs(round(sq, 9)) > abs(round(sd, 9)) qfirst from shap) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, k as rank, case when (k = 1) = qfirst then 'l_quantity' else 'l_discount' end feature, round(case when (k = 1) = qfirst then sq else sd end, 6) shap_value, round(base, 6) base_value, round(case when k = 2 then base + sq + sd when qfirst then base + sq else base + sd end, 6) upto from l, (values (1), (2)) t(k)")
def waterfall(spark, sf_dir):
    own = attribution.shapley_rows(ml_rows(spark, sf_dir), tiny_forest(spark), TREE, ROW_KEY)
    own = own.withColumn("shap_values", F.transform("shap_values", lambda v: F.round(v, 9)))
    return rounded(report.waterfall_rows(own, TREE, ROW_KEY))


@query(f"with {ML}, {_SHAP} select 'l_quantity' feature, round(avg(sq), 6) shap_value, round(avg(l_quantity), 6) feature_value, round(avg(base), 6) base_value from shap where l_suppkey < 50 union all select 'l_discount', round(avg(sd), 6), round(avg(l_discount), 6), round(avg(base), 6) from shap where l_suppkey < 50")
def mean_explanation(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").filter("s_suppkey < 50").select(F.col("s_suppkey").alias("l_suppkey"))
    return rounded(report.mean_explanation(explained(spark, sf_dir), points, ["l_suppkey"]))


@query(f"with {ML}, {_SHAP} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(sq, 6) l_quantity, round(sd, 6) l_discount from shap")
def shap_heatmap(spark, sf_dir):
    return rounded(reshape.explanation_wide(explained(spark, sf_dir), TREE, ROW_KEY))


# -- report tables --------------------------------------------------------------------------------
@query(f"with {ML}, i as (" + " union all ".join(f"select '{f}' feature, abs(corr({f}, target)) importance, stddev_pop({f}) / (avg({f}) * 100) as std from ml" for f in FEATURES) + ") select feature, round(importance / max(importance) over (), 6) importance, round(std / max(importance) over (), 6) as std from i order by importance desc limit 4")
def importance_topk(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    facts = rows.agg(*(F.struct(F.lit(f).alias("feature"), F.abs(F.corr(f, "target")).alias("importance"), (F.stddev_pop(f) / (F.avg(f) * 100)).alias("std")).alias(f) for f in FEATURES))
    importance = facts.select(F.explode(F.array(*FEATURES)).alias("x")).select("x.*")
    return rounded(report.importance_bars(importance, top=4))


@query(f"with {_PRED}, m as (select cast(l_suppkey % 10 as double) lat, cast(l_partkey % 10 as double) lon, avg(target) target, avg(predict) predict from p group by 1, 2) select lat, lon, round(target, 4) target, round(predict, 4) predict, round(target - predict, 4) residual, round(min(least(target, predict)) over (), 4) low, round(max(greatest(target, predict)) over (), 4) high from m")
def residual_map(spark, sf_dir):
    own = predicted(spark, sf_dir).withColumns({"lat": (F.col("l_suppkey") % 10).cast("double"), "lon": (F.col("l_partkey") % 10).cast("double")})
    return rounded(report.residual_maps(own), 4)


@query(f"with {_PRED} select cast(least(floor(target / 5000), 19) as bigint) bin_x, cast(least(floor(predict / 5000), 19) as bigint) bin_y, count(*) n from p where target between 0 and 100000 and predict between 0 and 100000 group by 1, 2")
def density_2d(spark, sf_dir):
    return report.density(predicted(spark, sf_dir), 0.0, 100000.0, 20)


@query(f"with {_PRED}, e as (select min(least(target, predict)) a, max(greatest(target, predict)) b from p) select round(a - abs(a) * 0.05, 4) low, round(b + abs(b) * 0.05, 4) high from e")
def axis_limits(spark, sf_dir):
    return rounded(report.axis_limits(predicted(spark, sf_dir)), 4)


@query(f"with {CUBE}, r as (select lat, lon, time, case when gas_view between 0 and 5 then null else gas_view end v, gas_click c, gas_error e from cube where lat between -20 and 40 and not (day(time) = 29)), d as (select lat, lon, cast(time as date) time, avg(c) filter ({_LOCAL} between 28800 and 54000) c, max(v) filter ({SECONDS} = 46800) v, avg(e - 2 * c) x from r group by 1, 2, 3), t as (select lat, lon, time, v, x, c - x target from d), z as (select *, (v - avg(v) over ()) / nullif(stddev_pop(v) over (), 0) zv from t) select lat, lon, count(*) n, round(avg(zv), 5) v, round(avg(target), 5) target from z group by 1, 2")
def workflow_rows(spark, sf_dir):
    spec = workflow.Spec(
        target="(gas_click) - (x)", variables=["gas_view"], ranges={"lat": (-20, 40)}, drop={"day": 29}, replace={"gas_view": (0, 5, None)},
        calc={"x": "(gas_error) - 2 * (gas_click)"}, scale=True,
        sections=[{"vars": ["gas_click"], "time": (8, 15), "local": True}, {"vars": ["gas_view"], "time": 13}, {"vars": ["x"], "time": (0, 24)}],
    )
    rows, _ = workflow.load(spark, spec, cube_hourly(spark, sf_dir))
    return rounded(rows.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.avg("gas_view").alias("v"), F.avg("target").alias("target")), 5)


# -- trained models (no SQL trains a forest: rows and invariants are tested instead) -----------------
def training(spark, sf_dir, deal=forest.bounded):
    rows, _ = forest.prepare(ml_rows(spark, sf_dir), FEATURES, deal=deal)
    return rows


FOREST = {"numTrees": 10, "maxDepth": 5}
#: each of these years is held out once
YEARS = range(1995, 2002)


def stored_training(spark, sf_dir, by_year: bool = False, keys=ROW_KEY) -> DataFrame:
    """The training rows without vectors, with ``keys`` and the hash of all keys (``id``), stored, so that nothing stays in memory.  They
    are joined once, whatever is counted later, and dealt by the number of rows that the files' footers name.  With ``by_year`` folds read
    theirs from files, and tasks sort bounded parts of the rows; else a large table is neither exchanged nor sorted."""
    path, deal = shared(spark, "training"), forest.bounded if by_year else forest.spread
    rows = ml_rows(spark, sf_dir).select(*keys, growth.identity(ROW_KEY), *FEATURES, "target", "year")
    deal(rows, table(spark, sf_dir, "lineitem").count()).write.partitionBy(*(["year"] if by_year else [])).parquet(path)
    ready, _ = forest.prepare(spark.read.parquet(path), FEATURES, deal=lambda df, _: df)
    return ready.drop("features")


def grown_points(spark, rows, kind=growth.forests, **params) -> tuple[DataFrame, list, list[list[tuple]]]:
    """The rows in blocks, the edges of their bins, and of each held-out year the node rows of its forest; the trees of all years grow
    together."""
    number = {y: i for i, y in enumerate(YEARS)}
    edges = growth.bin_edges(rows, FEATURES)
    fold = F.coalesce(*(F.when(F.col("year") == y, F.lit(i)) for y, i in number.items()), F.lit(len(number)))
    points = growth.stored(growth.points(rows.filter("year is not null"), FEATURES, None, fold, edges), shared(spark, "points"))
    return points, edges, kind(points, edges, len(number), **params)


def grown_folds(spark, sf_dir, kind=growth.forests, keys=ROW_KEY, **params) -> tuple[DataFrame, list[list[tuple]]]:
    """The stored rows, and of each held-out year the node rows of its forest."""
    rows = stored_training(spark, sf_dir, keys=keys)
    return rows, grown_points(spark, rows, kind, **params)[2]


#: rows with their ``fold`` take the forest of that year
OWN_FOREST = ("fold", YEARS)


def held_rows(rows: DataFrame) -> DataFrame:
    """The rows of all held-out years with their ``fold``, so that one pass does what is done row by row."""
    return rows.filter(F.col("year").between(YEARS[0], YEARS[-1])).withColumn("fold", F.col("year").cast("int"))


def nodes_of(spark, nodes) -> DataFrame:
    return spark.createDataFrame(nodes, attribution.NODES)


def held(rows: DataFrame, year: int) -> DataFrame:
    return rows.filter(F.col("year") == year)


def fold_scores(spark, sf_dir, kind=growth.forests, **params) -> DataFrame:
    points, edges, nodes = grown_points(spark, stored_training(spark, sf_dir, keys=()), kind, **params)
    got = growth.held_predicted(points, nodes, edges, kind is growth.boosted)
    return stats.scores(got.withColumn("fold", F.col("number") + YEARS[0]), by=["fold"]).select("mape", "rmse", "r2", "r", "n", "fold")


@query()
def rf_fold_scores(spark, sf_dir):
    return fold_scores(spark, sf_dir, **FOREST)


@query()
def rf_importance(spark, sf_dir):
    model = forest.estimator(**FOREST).fit(training(spark, sf_dir).filter("year <> 1998"))
    return report.importance_bars(forest.model_importance(model, spark, FEATURES))


@query()
def rf_attribution(spark, sf_dir):
    rows, nodes = grown_folds(spark, sf_dir, **FOREST)
    own = attribution.interpret_rows(held_rows(rows), nodes_of(spark, growth.in_one(nodes)), FEATURES, ["fold", *ROW_KEY], forests=OWN_FOREST)
    return attribution.long_contributions(own, [*ROW_KEY, "fold"]).select(*ROW_KEY, "predict", "bias", "feature", "contribution", "fold")


def grown_quantiles(spark, sf_dir, keys) -> tuple:
    """The stored rows, their blocks, edges and node rows, and the quantiles of each kind of held-out rows."""
    rows = stored_training(spark, sf_dir, keys=keys)
    points, edges, nodes = grown_points(spark, rows, numTrees=5, maxDepth=5, minInstancesPerNode=20)
    store = lambda df, name: growth.stored(df, shared(spark, name))
    return rows, points, edges, nodes, growth.quantiles(points, nodes, edges, forest.interval_quantiles([90, 0]), rows, store)


@query()
def rf_quantiles(spark, sf_dir):
    rows, _, edges, nodes, found = grown_quantiles(spark, sf_dir, ROW_KEY)
    own = growth.kinds_of(held_rows(rows), nodes, edges, FEATURES, [*ROW_KEY, "fold"], OWN_FOREST)
    return own.join(found, "kind").select(*ROW_KEY, *(c for c in found.columns if c != "kind"), "fold")


def permuted(spark, sf_dir, repeats: int) -> DataFrame:
    """(feature, importance, std, n, fold) of the forests of all held-out years."""
    points, edges, nodes = grown_points(spark, stored_training(spark, sf_dir, keys=()), **FOREST)
    return growth.permutation_importance(points, nodes, edges, FEATURES, repeats).select("feature", "importance", "std", "n", (F.col("number") + YEARS[0]).alias("fold"))


@query()
def perm_importance(spark, sf_dir):
    return permuted(spark, sf_dir, 5).drop("n")


@query()
def grid_search(spark, sf_dir):
    rows = training(spark, sf_dir).withColumn("fold", (F.col("year") % 2).cast("int")).cache()
    out = forest.best_model(rows, {"maxDepth": [3, 5]}, numTrees=5)[1]
    rows.unpersist()
    return out


# what holds for every trained model, whatever its trees: SQL says which rows there are and what is true of them
_FOLDS = f"with {ML} select cast(year as integer) fold, count(*) n"
_HELD = f"from ml where year between {YEARS[0]} and {YEARS[-1]} group by 1"


@query(f"{_FOLDS}, true as good {_HELD}")
def rf_scores_are_good(spark, sf_dir):
    """Of each held-out year: its rows, all predicted, and whether R2 is over 0.9 and r over 0.95."""
    return fold_scores(spark, sf_dir, **FOREST).select("fold", "n", ((F.col("r2") > 0.9) & (F.col("r") > 0.95) & (F.col("rmse") > 0)).alias("good"))


@query(f"{_FOLDS}, true as good {_HELD}")
def gbt_scores_are_good(spark, sf_dir):
    got = fold_scores(spark, sf_dir, growth.boosted, maxIter=5, maxDepth=4)
    return got.select("fold", "n", (F.col("r2") > 0.9).alias("good"))


@query(f"{_FOLDS}, cast(0 as bigint) violations {_HELD}")
def rf_additivity(spark, sf_dir):
    """Of each held-out year: its rows, and those whose prediction isn't bias plus contributions."""
    points, edges, nodes = grown_points(spark, stored_training(spark, sf_dir, keys=()), **FOREST)
    return off_balance(attribution.interpret_held(points, nodes, edges).withColumn("fold", F.col("number") + YEARS[0]), ["fold"])


@query(f"{_FOLDS}, cast(0 as bigint) violations {_HELD}")
def rf_shap_local_accuracy(spark, sf_dir):
    """Of each held-out year: its rows, and those whose prediction isn't the base value plus the Shapley values."""
    rows, nodes = grown_folds(spark, sf_dir, keys=(), numTrees=3, maxDepth=4)
    nodes = nodes_of(spark, growth.in_one(nodes))
    own = growth.predicted(held_rows(rows), nodes, FEATURES, [*FEATURES, "fold"], forests=OWN_FOREST)
    both = attribution.shapley_rows(own, nodes, FEATURES, ["predict", "fold"], forests=OWN_FOREST)
    off = F.abs(F.aggregate("shap_values", F.col("base_value"), lambda a, x: a + x) - F.col("predict")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("predict"))
    return both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(off.cast("bigint")), F.lit(0)).alias("violations"))


@query(f"{_FOLDS}, cast(0 as bigint) crossed, true as covered {_HELD}")
def rf_interval_coverage(spark, sf_dir):
    """Of each held-out year: its rows, those with quantiles out of order, and whether 90 % intervals hold 80 % or more."""
    _, points, edges, nodes, found = grown_quantiles(spark, sf_dir, ())
    met = growth.held_kinds(points, nodes, edges).join(found, "kind")
    crossed = ((F.col("q_0_05") > F.col("q_0_5")) | (F.col("q_0_5") > F.col("q_0_95"))).cast("bigint")
    inside = F.avg(F.col("target").between(F.col("q_0_05"), F.col("q_0_95")).cast("double"))
    return met.groupBy((F.col("number") + YEARS[0]).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(crossed).alias("crossed"), (inside >= 0.8).alias("covered"))


@query(f"{_FOLDS}, 5 as features, 1.0::double as total, 'l_extendedprice' as best {_HELD}")
def rf_importance_sums(spark, sf_dir):
    """Of each held-out year: its rows, the number and sum of importances, and the feature with the greatest."""
    rows, nodes = grown_folds(spark, sf_dir, keys=(), **FOREST)
    bars = reduce(DataFrame.unionByName, (growth.importance(own, spark, FEATURES).withColumn("fold", F.lit(y)) for y, own in zip(YEARS, nodes, strict=True)))
    facts = bars.groupBy("fold").agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 9).alias("total"), F.max_by("feature", "importance").alias("best"))
    return facts.join(held_rows(rows).groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold")


@query(f"{_FOLDS}, 5 as features, 'l_extendedprice' as best, true as sound {_HELD}")
def perm_importance_order(spark, sf_dir):
    """Of each held-out year: the feature whose permutation costs most, and whether features that the target doesn't
    depend on cost nothing."""
    sound = F.max(F.when(F.col("feature").isin("p_size", "l_quantity"), F.col("importance"))) < 0.2
    return permuted(spark, sf_dir, 3).groupBy("fold", "n").agg(F.count(F.lit(1)).cast("int").alias("features"), F.max_by("feature", "importance").alias("best"), sound.alias("sound"))


@query("select 2 as tried, 5 as best_depth, true as ordered")
def grid_search_choice(spark, sf_dir):
    """The deeper trees have the lesser error over the folds."""
    rows = training(spark, sf_dir).withColumn("fold", (F.col("year") % 2).cast("int")).cache()
    model, tried = forest.best_model(rows, {"maxDepth": [2, 5]}, numTrees=5)
    rows.unpersist()
    return tried.agg(F.count(F.lit(1)).cast("int").alias("tried"), F.lit(model.getMaxDepth()).alias("best_depth"), (F.min_by("maxDepth", "rmse") == model.getMaxDepth()).alias("ordered"))


@query(f"with {ML} select 6 as trees, cast(0 as bigint) over_cap, count(*) n from ml")
def leaf_capped_forest(spark, sf_dir):
    """No tree of a forest with a cap of 24 leaves has more of them."""
    n, per = capped_sizes(spark, sf_dir, 24)
    return per.agg(F.count(F.lit(1)).cast("int").alias("trees"), F.coalesce(F.sum((F.col("leaves") > 24).cast("bigint")), F.lit(0)).alias("over_cap"), F.lit(n).cast("bigint").alias("n"))


def capped_sizes(spark, sf_dir, cap: int) -> tuple[int, DataFrame]:
    """The number of rows, and of each tree its leaves as fitted and under the cap."""
    rows = training(spark, sf_dir).cache()
    n = rows.count()
    model = forest.estimator(numTrees=6, maxDepth=10).fit(rows)
    nodes = attribution.node_table(model, shared(spark, "forest"), spark)
    rows.unpersist()
    count = lambda t, name: t.groupBy("tree").agg(F.count_if(F.col("feature") < 0).alias(name))
    return n, count(nodes, "full").join(count(trees.leaf_capped(nodes, cap), "leaves"), "tree")


@query("select cast(t as integer) tree, true as exact, true as capped from range(0, 6) r(t)")
def leaf_capped_exact(spark, sf_dir):
    """Each tree has exactly as many leaves as the cap and its splits allow, and the cap is met."""
    _, per = capped_sizes(spark, sf_dir, 24)
    return per.select("tree", (F.col("leaves") == F.least("full", F.lit(24))).alias("exact"), (F.col("full") > 24).alias("capped"))


#: a tree whose best splits are deep on the right: (tree, node, value, cover, feature, threshold, left, right)
_DEEP = [
    (0, 0, 50.0, 100.0, 0, 25.0, 1, 2), (0, 1, 40.0, 50.0, 1, 0.05, 3, 4), (0, 2, 60.0, 50.0, 1, 0.03, 5, 6), (0, 3, 39.0, 25.0, -1, None, -1, -1), (0, 4, 41.0, 25.0, -1, None, -1, -1),
    (0, 5, 50.0, 25.0, 0, 30.0, 7, 8), (0, 6, 70.0, 25.0, 0, 40.0, 9, 10), (0, 7, 49.5, 12.0, -1, None, -1, -1), (0, 8, 50.5, 13.0, -1, None, -1, -1), (0, 9, 55.0, 10.0, -1, None, -1, -1), (0, 10, 80.0, 15.0, -1, None, -1, -1),
]


@query(f"with {ML}, t as (select *, case when l_quantity <= 25 then 40.0 when l_discount <= 0.03 then 50.0 when l_quantity <= 40 then 55.0 else 80.0 end x4, case when l_quantity <= 25 then 40.0 when l_discount <= 0.03 then 50.0 else 70.0 end x3 from ml) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, x3 as predict_3, x4 as predict_4 from t")
def leaf_capped_literal(spark, sf_dir):
    """Predictions of a literal tree under caps of 3 and 4 leaves: the deep splits on the right gain more than the one on the left."""
    nodes = spark.createDataFrame(_DEEP, attribution.NODES)
    own = ml_rows(spark, sf_dir)
    for cap in (3, 4):
        got = attribution.interpret_rows(own, trees.leaf_capped(nodes, cap), TREE, [*ROW_KEY, *TREE, *(["predict_3"] if cap == 4 else [])])
        own = got.withColumnRenamed("predict", f"predict_{cap}").drop("bias", "contributions")
    return own.drop(*TREE)


@query(f"with {ML} select count(*) n, true as good from ml where year >= 2000 and p_size > 25")
def external_test_scores(spark, sf_dir):
    """A model of the years before 1998 on another selection of rows."""
    rows = training(spark, sf_dir)
    model = forest.estimator(**FOREST).fit(rows.filter("year < 1998"))
    return stats.scores(model.transform(rows.filter("year >= 2000 and p_size > 25"))).select("n", (F.col("r2") > 0.9).alias("good"))


@query(f"with {ML} select count(*) n, cast(0 as bigint) different from ml where year = 1998")
def model_round_trip(spark, sf_dir):
    """A stored model, read back, predicts what it did."""
    rows = training(spark, sf_dir)
    model = forest.estimator(numTrees=3, maxDepth=4).fit(rows.filter("year <> 1998"))
    path = shared(spark, "run")
    model.write().save(f"{path}/model/run=a/month=all/fold_year=1998")
    again = tables.load_objects(spark, path, ["model"], run="a", month="all", fold_year=1998)["model"]
    both = model.transform(held(rows, 1998)).select(*ROW_KEY, "predict").join(again.transform(held(rows, 1998)).select(*ROW_KEY, F.col("predict").alias("p")), ROW_KEY)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") != F.col("predict")).alias("different"))


@query(f"with {ML} select count(*) n, cast(5 as integer) size, round(sum(l_quantity + l_discount), 4) total from ml where l_quantity <> 7")
def prepared_rows(spark, sf_dir):
    """Complete rows as vectors: infinities and NaN drop a row, a feature without any value is left out, coordinates aren't
    features."""
    bad = F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows, empty = forest.prepare(ml_rows(spark, sf_dir).withColumns({"l_quantity": bad, "nothing": F.lit(None).cast("double")}), [*FEATURES, "nothing"])
    v = vector_to_array("features")
    return rows.groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v[0] + v[2]), 4).alias("total")).select("n", "size", "total") if empty == ["nothing"] else rows.limit(0)


# -- whole runs: files of several sources to scored and explained folds -----------------------------
def stored_sources(spark, sf_dir) -> list[str]:
    """The cube as two files of one source, with dotted names, a second source and attributes of the cells."""
    cube, path = cube_hourly(spark, sf_dir), shared(spark, "sources")
    first = cube.filter("lat <= 20").select("lat", "lon", "time", *(F.col(f"gas_{v}").alias(f"momo.{v}") for v in ("click", "view")))
    first.filter("lat <= 0").write.parquet(f"{path}/momo/2023")
    first.filter("lat > 0").write.parquet(f"{path}/momo/2024")
    cube.filter("lat >= -20 and gas_error is not null").select("lat", "lon", "time", F.col("gas_error").alias("toar.error")).write.parquet(f"{path}/toar")
    nation = table(spark, sf_dir, "nation")
    cells = cube.select("lat", "lon").distinct().crossJoin(nation.agg(F.count(F.lit(1)).cast("double").alias("nations"), F.max("n_nationkey").cast("double").alias("last")))
    cells.select("lat", "lon", (F.col("nations") + F.col("lat")).alias("people")).write.parquet(f"{path}/cells")
    return [f"{path}/momo/202[3-4]", f"{path}/toar", f"{path}/cells"]


_SOURCES = f"{CUBE}, m as (select lat, lon, time, gas_click click, gas_view v from cube where lat <= 20), t as (select lat, lon, time, gas_error error from cube where lat >= -20 and gas_error is not null), j as (select coalesce(m.lat, t.lat) lat, coalesce(m.lon, t.lon) lon, coalesce(m.time, t.time) time, click, v, error from m full join t on m.lat = t.lat and m.lon = t.lon and m.time = t.time)"


@query(f"with {_SOURCES} select lat, lon, time, round(click, 6) momo_click, round(v, 6) momo_view, round(error, 6) toar_error, (select count(*) from nation) + lat people from j")
def read_cube_of_sources(spark, sf_dir):
    return rounded(tables.read_cube(spark, *stored_sources(spark, sf_dir)).select("lat", "lon", "time", "momo_click", "momo_view", "toar_error", "people"))


@query(f"with {_SOURCES}, d as (select lat, lon, cast(time as date) as time, avg(click) filter ({SECONDS} between 28800 and 54000) c, max(v) filter ({SECONDS} = 46800) v, avg(error) e from j group by 1, 2, 3) select lat, lon, time, round(v, 6) momo_view, (select count(*) from nation) + lat people, round(c - e, 6) target from d")
def load_of_sources(spark, sf_dir):
    """A target of dotted names from two sources, and an attribute that daily values carry along."""
    spec = workflow.Spec(target="(momo.click) - (toar.error)", globs=stored_sources(spark, sf_dir), variables=["momo.view"], static=["people"], sections=[{"vars": "momo.click", "time": (8, 15)}, {"vars": "momo.view", "time": 13}, {"vars": "toar.*", "time": (0, 24)}])
    return rounded(workflow.load(spark, spec)[0].select("lat", "lon", "time", "momo_view", "people", "target"))


RUN_YEARS = (2022, 2023, 2024)


def years_of_cube(spark, sf_dir) -> DataFrame:
    """The cube in each of three years, with a variable that depends on two others."""
    cube = cube_hourly(spark, sf_dir).withColumn("y", F.col("gas_click") * 2 + F.col("gas_view"))
    return cube.withColumn("__y", F.explode(F.array(*(F.lit(y) for y in RUN_YEARS)))).withColumn("time", F.col("time") - F.make_ym_interval(F.lit(2024) - F.col("__y"))).drop("__y")


RUN = workflow.Spec(target="y", variables=["gas_(click|view)"], sections=[{"vars": "gas_.*|y", "time": (0, 24)}])
_DAYS = f"{CUBE}, days as (select lat, lon, cast(time as date) d, avg(gas_click) c, avg(gas_view) v, avg(gas_click * 2 + gas_view) y from cube group by 1, 2, 3), runs as (select cast(x as integer) fold_year, lat, lon, cast(d - to_years(cast(2024 - x as integer)) as date) d from days, (select unnest([{', '.join(map(str, RUN_YEARS))}]) x) where c is not null and v is not null and y is not null)"


def stored_run(spark, sf_dir, **params) -> tuple[str, list[str], DataFrame]:
    path = shared(spark, "run")
    rows, features = workflow.load(spark, RUN, years_of_cube(spark, sf_dir))
    return path, features, workflow.train(rows, features, RUN_YEARS, path, "r", numTrees=3, maxDepth=4, **params)


@query(f"with {_DAYS} select fold_year, 'all' as month, count(*) n, true as same, true as numbers from runs group by 1")
def run_scores(spark, sf_dir):
    """Files to scored folds, and the scores once more from what was stored."""
    path, _, scores = stored_run(spark, sf_dir)
    again = workflow.rescore(spark, path, "r").select("month", "fold_year", F.col("r2").alias("r2_again"))
    return scores.join(again, ["month", "fold_year"]).select("fold_year", "month", "n", (F.abs(F.col("r2") - F.col("r2_again")) < 1e-9).alias("same"), (F.col("rmse") >= 0).alias("numbers"))


@query(f"with {_DAYS} " + " union all ".join(f"select '{m}' as mode, fold_year, 2 * count(*) n, cast(0 as bigint) violations from runs group by 2" for m in ("shap", "path")))
def run_explanations(spark, sf_dir):
    """Both explanations of stored folds: a row for each feature, which add up to the stored predictions."""
    path, features, _ = stored_run(spark, sf_dir)
    stored = spark.read.parquet(f"{path}/predict").select("lat", "lon", "time", "fold_year", "predict")
    out = None
    for mode in ("shap", "path"):
        long = workflow.explain(spark, path, "r", features, mode, work=shared(spark, "nodes"))
        total = long.groupBy("lat", "lon", "time", "fold_year").agg((F.sum("shap_value") + F.max("base_value")).alias("total"), F.count(F.lit(1)).alias("n"))
        off = F.count_if(F.abs(F.col("total") - F.col("predict")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("predict")))
        one = total.join(stored, ["lat", "lon", "time", "fold_year"], "left").groupBy("fold_year").agg(F.sum("n").alias("n"), off.alias("violations")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_DAYS}, f as (select fold_year, min(d) a, max(d) b, count(distinct d) % 3 rest from runs group by 1), bins as (select runs.fold_year, lat, lon, datediff('day', a, d) // 3 k, datediff('day', a, b) // 3 last, rest from runs join f on f.fold_year = runs.fold_year) select fold_year, count(distinct (lat, lon, k)) * 2 n from bins where rest = 0 or k < last group by 1")
def run_explanations_of_three_days(spark, sf_dir):
    path, features, _ = stored_run(spark, sf_dir)
    long = workflow.explain(spark, path, "r", features, "path", work=shared(spark, "nodes"), days=3)
    return long.groupBy("fold_year").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DAYS}, twice as (select fold_year, 'jan' as month, d from runs union all select fold_year, 'mar', d from runs) select fold_year, month, count(*) n from twice group by 1, 2")
def monthly_runs(spark, sf_dir):
    """A run for each of the months 1-6:2 that has rows; the cube's days are in January, and again in March."""
    cube = years_of_cube(spark, sf_dir)
    march = cube.withColumn("time", F.col("time") + F.expr("interval 2 months"))
    scores = workflow.train_months(spark, RUN, "1-6:2", RUN_YEARS, shared(spark, "run"), "m", cube.unionByName(march), numTrees=2, maxDepth=3)
    return scores.select("fold_year", "month", "n")


@query("select 'r' as run, m as month, y as fold_year, cast(row_number() over (order by k, y) as integer) as place from (values ('feb', 2), ('jul', 7), ('oct', 10)) a(m, k), (select distinct cast(year(o_orderdate) as integer) y from orders)")
def fold_discovery(spark, sf_dir):
    """The stored folds of a run, months in the order of the calendar."""
    path = shared(spark, "run")
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("fold_year"), F.col("o_orderkey").cast("double").alias("lon")).groupBy("fold_year").agg(F.max("lon").alias("lon"))
    for month in ("oct", "feb", "jul"):
        years.withColumns({"run": F.lit("r"), "month": F.lit(month)}).write.mode("append").partitionBy("run", "month", "fold_year").parquet(f"{path}/explanation")
    found = tables.folds_of(tables.load_objects(spark, path, ["explanation"], run="r")["explanation"])
    return found.select("run", "month", "fold_year", F.row_number().over(Window.partitionBy("run").orderBy("month_no", "fold_year")).alias("place"))


# -- more of sources and sinks ---------------------------------------------------------------------
@query("select year(l_shipdate)::integer as year_of, month(l_shipdate)::integer as month_of, count(*) n, count(distinct l_orderkey) orders from lineitem where year(l_shipdate) <> 1996 or month(l_shipdate) <> 2 or l_quantity > 25 group by 1, 2")
def save_by_month_twice(spark, sf_dir):
    """A second write replaces its own months only; a column named month stays as it is."""
    path = shared(spark, "by-month")
    own = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_orderkey", F.lit("m").alias("month"))
    tables.save_by_month(own, path, "l_shipdate")
    tables.save_by_month(own.filter("year(l_shipdate) = 1996 and month(l_shipdate) = 2 and l_quantity > 25"), path, "l_shipdate")
    return spark.read.parquet(path).filter("month = 'm'").groupBy("year_of", "month_of").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("select case event_type when 'view' then 'seen' else event_type end as variable, count(*) n, round(sum(value), 4) total from events where event_type in ('click', 'view') group by 1")
def consolidate_folders(spark, sf_dir):
    """The files of two variables as partitions of one table, one renamed; done twice, with the same result."""
    path, e = shared(spark, "folders"), table(spark, sf_dir, "events")
    for v in ("click", "view"):
        e.filter(F.col("event_type") == v).select("event_id", F.col("value").alias(v)).write.parquet(f"{path}/{v}")
    for _ in range(2):
        tables.consolidate(spark, {v: f"{path}/{v}" for v in ("click", "view")}, f"{path}/all", {"view": "seen"})
    return spark.read.parquet(f"{path}/all").groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {CUBE}, d as (select lat, lon, avg(gas_click) c, avg(gas_view) v from cube where lat >= 0 group by 1, 2), g as (select * from (select distinct lat from cube), (select distinct lon from cube)) select g.lat, g.lon, round(c, 6) gas_click, round(v, 6) gas_view, 'r1' as run, 'test' as kind from g left join d on g.lat = d.lat and g.lon = d.lon")
def saved_objects(spark, sf_dir):
    """A long object made wide on the full grid, stored and read back by run and kind; objects that aren't there are left out."""
    cube, path = cube_hourly(spark, sf_dir), shared(spark, "objects")
    long = reshape.to_long(stats.time_mean(cube.filter("lat >= 0"), VARIABLES[:2]), VARIABLES[:2], ["lat", "lon"])
    grid_ = reshape.full_grid(cube, ["lat", "lon"])
    tables.save_object(long, path, "predict", {"run": "r1", "kind": "test"}, grid_, wide=VARIABLES[:2])
    tables.save_objects(path, {"run": "r'2", "kind": "test"}, ["predict", "explanation"], predict=stats.time_mean(cube, VARIABLES[:2]), explanation=None)
    got = tables.load_objects(spark, path, ["predict", "explanation"], run="r1", kind="test")
    return rounded(got["predict"].select("lat", "lon", *VARIABLES[:2], "run", "kind")) if got["explanation"] is None else got["explanation"]


@query("select s_suppkey station, s_name as name, round(s_acctbal, 2) lat, s_suppkey * 1.5::double lon from supplier")
def csv_stations(spark, sf_dir):
    """A station table from CSV, with the columns' names made those of a cube."""
    path = shared(spark, "csv")
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("station_lat"), (F.col("s_suppkey") * 1.5).alias("station_lon"))
    own.write.option("header", "true").csv(path)
    return tables.station_table(tables.read_csv(spark, path, f"station {dict(own.dtypes)['station']}, name string, station_lat double, station_lon double"))


@query(f"with {CUBE}, s as (select *, case when lon >= 180 then lon - 360 else lon end x from cube) select lat, x lon, count(*) n, case when lat between 35 and 65 and x between -10 and 25 then 'Europe' when lat between 20 and 50 and x between 100 and 145 then 'Asia' else 'NorthAmerica' end region from s where (lat between 35 and 65 and x between -10 and 25) or (lat between 20 and 50 and x between 100 and 145) or (lat between 20 and 55 and x between -125 and -70) group by all")
def region_presets(spark, sf_dir):
    cube = cube_hourly(spark, sf_dir).withColumn("lon", fn.to_signed(F.col("lon")))
    return reshape.concat(*(select.sel_regions(cube, {r: box}, dropna=False).withColumn("region", F.lit(r)) for r, box in select.REGIONS.items())).groupBy("lat", "lon", "region").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CUBE} select lat, lon, time, round(gas_click / nullif(gas_view - gas_view, 0), 6) never, round((gas_click + 1) / nullif(gas_error - 10, 0) * -2, 6) other from cube")
def calc_divisions(spark, sf_dir):
    """Divisors that are formulas themselves; by zero gives null."""
    own = select.with_calculated(cube_hourly(spark, sf_dir), {"never": "(gas_click) / ((gas_view) - (gas_view))", "other": "((gas_click) + 1) / ((gas_error) - 10) * -2"})
    return rounded(own.select("lat", "lon", "time", "never", "other"))


_GAPS = f"{SITES}, gaps as (select site, ts, case when hour(ts) % 7 = 3 then null else value end as value from sites)"


@query(f"with {_GAPS}, w as (select a.site, cast(a.ts as date) as day, a.ts, avg(b.value) m, count(*) n from gaps a join gaps b on a.site = b.site and cast(a.ts as date) = cast(b.ts as date) and b.ts >= a.ts and b.ts < a.ts + interval 8 hour group by 1, 2, 3), s as (select *, first_value(n) over (partition by site, day order by ts) need from w), t as (select *, max(case when n <> need then 1 else 0 end) over (partition by site, day order by ts rows unbounded preceding) stopped from s) select site, day, round(max(case when stopped = 0 then m end), 9) mda8 from t group by 1, 2")
def mda8_gaps(spark, sf_dir):
    """Samples without a value count as samples."""
    own = site_hourly(spark, sf_dir).withColumn("value", F.when(F.hour("ts") % 7 != 3, F.col("value")))
    return rounded(temporal.max_daily_mean(own), 9)


@query(f"with {CUBE}, f as (select date_trunc('day', min(time)) a, max(time) b from cube), bins as (select unnest(generate_series(a, b, interval 6 hour)) bin from f), cells as (select distinct lat, lon from cube) select cells.lat, cells.lon, bin, round(avg(gas_click), 9) gas_click, round(avg(gas_view), 9) gas_view from cells cross join bins left join cube on cube.lat = cells.lat and cube.lon = cells.lon and time >= bin and time < bin + interval 6 hour group by 1, 2, 3")
def resample_6h_mean(spark, sf_dir):
    return rounded(temporal.resample_hours(cube_hourly(spark, sf_dir), 6, "mean", ["gas_click", "gas_view"]), 9)


_WEEKS = f"{CUBE}, own as (select * from cube where week(time) % 2 = 1), w as (select cast(unnest(generate_series(date_trunc('week', min(time)), date_trunc('week', max(time)), interval 7 day)) as date) + 6 bin from own), cells as (select distinct lat, lon from own)"


@query(f"with {_WEEKS} select cells.lat, cells.lon, bin, count(gas_click) gas_click from cells cross join w left join own on own.lat = cells.lat and own.lon = cells.lon and cast(date_trunc('week', time) as date) + 6 = bin group by 1, 2, 3")
def resample_week_with_gaps(spark, sf_dir):
    """Weeks without a sample, between others, are there with a count of 0."""
    return temporal.resample_calendar(cube_hourly(spark, sf_dir).filter("weekofyear(time) % 2 = 1"), "week", "count", ["gas_click"])


@query("with h as (select o_orderkey, row_number() over (order by md5('11|' || o_orderkey), o_orderkey) - 1 p, count(*) over () n from orders) select o_orderkey, cast(case when p < (n % 7) * (n // 7 + 1) then p // (n // 7 + 1) else n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) end as integer) fold from h")
def kfold_shuffled(spark, sf_dir):
    return folds.shuffled_folds(table(spark, sf_dir, "orders").select("o_orderkey"), 7, ["o_orderkey"], seed=11)


@query("select event_type as input, case event_type when 'view' then 2 when 'error' then 2 else 1 end::bigint entries, 'ok' as status, count(*)::bigint as logged, count(*) n, round(sum(value), 4) total from events group by 1")
def refresh_of_outputs(spark, sf_dir):
    """An input that fails once and one that has changed are written by the second refresh, the others not again; every output is there
    once, with the rows that the log says."""
    e, out, path = table(spark, sf_dir, "events"), shared(spark, "outputs"), shared(spark, "log")
    kinds = e.select(F.col("event_type").alias("input")).distinct()

    def process(kind: str, broken: tuple = ()) -> DataFrame:
        if kind in broken:
            raise ValueError(f"{kind} can't be read")
        return e.filter(F.col("event_type") == kind).select("event_id", "value")

    first = manifests.refresh(spark, kinds.withColumn("fingerprint", F.lit("1")), lambda k: process(k, ("error",)), out, path)
    changed = F.when(F.col("input") == "view", "2").otherwise("1")
    if first.filter("status = 'failed'").count() == 1:
        manifests.refresh(spark, kinds.withColumn("fingerprint", changed), process, out, path)
    there = spark.read.parquet(out).groupBy("input").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return there.join(manifests.state(spark, path).select("input", "entries", "status", F.col("rows").alias("logged")), "input")


@query(f"with {CUBE} select lat, lon, time, {r6(V)} from cube where month(time) = 1 and lat between -45 and 10 and lon between 10 and 110")
def cube_by_tiles(spark, sf_dir):
    """A month and a box of a cube that is stored by month and tile: other files aren't listed."""
    path = shared(spark, "cube")
    tables.save_cube(cube_hourly(spark, sf_dir), path)
    own = select.sel_month(tables.read_cube(spark, path), 1)
    return rounded(select.sel_regions(own, {"box": {"lat": (10, -45), "lon": (10, 110)}}, dropna=False).select("lat", "lon", "time", *VARIABLES))


def overlapping(spark, sf_dir) -> tuple[str, DataFrame]:
    """A cube as three files: two that share cells and variables, and one with another variable."""
    cube, path = cube_hourly(spark, sf_dir), shared(spark, "overlap")
    two = cube.select("lat", "lon", "time", "gas_click", "gas_view")
    two.filter("lat <= 20").write.parquet(f"{path}/a1")
    two.filter("lat >= 0").write.parquet(f"{path}/a2")
    cube.filter("lon > 100").select("lat", "lon", "time", "gas_error", "gas_click").write.parquet(f"{path}/b1")
    return path, cube


@query(f"with {CUBE} select lat, lon, time, round(gas_click, 6) gas_click, round(gas_view, 6) gas_view, round(case when lon > 100 then gas_error end, 6) gas_error from cube")
def read_cube_overlapping(spark, sf_dir):
    """Globs that match a file twice and sources that share coordinates and variables: a row for each coordinate."""
    path, _ = overlapping(spark, sf_dir)
    return rounded(tables.read_cube(spark, f"{path}/a*", f"{path}/a2", f"{path}/b1").select("lat", "lon", "time", "gas_click", "gas_view", "gas_error"))


@query(f"with {CUBE} select lat, lon, time, 'gas_click' as variable, round(gas_click, 6) low, round(gas_click + 1, 6) high, 2::bigint n_values from cube where lat between 0 and 20 and gas_click is not null")
def cube_conflicts(spark, sf_dir):
    """Where two sources have different values, with both."""
    path, cube = overlapping(spark, sf_dir)
    other = cube.filter("lat between 0 and 20").select("lat", "lon", "time", (F.col("gas_click") + 1).alias("gas_click"), "gas_view")
    return rounded(tables.conflicts_of([tables.read_cube(spark, f"{path}/a1"), other]))


@query(f"with {SITES}, s as (select *, row_number() over (partition by site order by ts) k from sites) select 'net' network, site station, cast(10.5 as double) lon, cast(length(site) as double) lat, ts datetime, case when k % 5 in (1, 2) or k % 5 = 3 then null else round(value, 6) end as mean from s where k % 5 <> 4")
def station_json_odd(spark, sf_dir):
    """Station files with ``NaN``, values that are no numbers, missing values and dates that can't be read: only these are lost."""
    path = shared(spark, "station-json")
    rows = site_hourly(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("ts")) % 5)
    value = F.when(F.col("k") == 1, "NaN").when(F.col("k") == 2, '"n/a"').when(F.col("k") == 3, "null").otherwise(F.format_string("%.9f", "value"))
    date = F.concat(F.lit('"'), F.when(F.col("k") == 4, "31.2.24").otherwise(F.col("ts").cast("string")), F.lit('"'))
    joined = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", date.alias("d"), value.alias("v")))), lambda x: x[c]), ", "), F.lit("]"))
    meta = F.to_json(F.struct(F.lit("net").alias("network_name"), F.col("site").alias("station_id"), F.lit(10.5).alias("station_lon"), F.length("site").cast("double").alias("station_lat")))
    text = rows.groupBy("site").agg(joined("d").alias("d"), joined("v").alias("v")).select(F.concat(F.lit('{"datetime": '), "d", F.lit(', "mean": '), "v", F.lit(', "metadata": '), meta, F.lit("}")))
    text.repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return rounded(tables.read_station_json(spark, path)[0])


@query(f"with {OBS}, c as (select date, cast(20 * floor(least(lat, 80) / 20) as double) lat, cast(30 * (floor((lon + 180) / 30) + 1) - 180 as double) lon, value from obs where lat between -80 and 90 and lon between -180 and 180) select date, lat, lon, round(avg(value), 6) obs_mean, count(value) obs_count from c group by 1, 2, 3")
def match_grid_north_to_south(spark, sf_dir):
    """Axes from north to south and from east to west give the cells that they give the other way round."""
    return rounded(grid.match_to_grid(station_obs(spark, sf_dir), LATS[::-1], LONS[::-1], ["mean", "count"]))


@query("with p as (select cast(l_quantity as double) x, cast(round(l_discount * 100) as double) y, count(*) c from lineitem group by 1, 2) select a.x, a.y, round(sum(b.c * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 128)) / (select sum(c) from p) / (128 * pi()), 9) density from p a join p b on abs(a.x - b.x) <= 32 and abs(a.y - b.y) <= 32 group by 1, 2")
def density_by_kernels(spark, sf_dir):
    """Kernel density at each point; these stand on whole numbers, where only the stated cut-off counts."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100).cast("double").alias("y"))
    points = own.withColumns({"kx": F.col("x"), "ky": F.col("y")})
    return rounded(report.kernel_density(points, ["kx", "ky"], 8.0, "x", "y").join(own.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), (F.col("kx") == F.col("x")) & (F.col("ky") == F.col("y"))).select("x", "y", (F.col("density") / F.col("n")).alias("density")), 9)


@query("select event_id, user_id from events")
def fixed_splits(spark, sf_dir):
    """Rows dealt into seven ranges and put together again are the same rows."""
    return table(spark, sf_dir, "events").select("event_id", "user_id").repartitionByRange(7, "event_id")
