"""Daily values, resampling, maxima of running means, thinning of axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymesh.functions.columns import matching, seconds_of_day, utc_offset_hours

REDUCERS = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def in_hours(rule: int | Sequence[int], local: bool) -> Column:
    """Whether a sample's time of day is in [h0:00:00, h1:00:00], both included, or just at h:00:00."""
    at = F.col("__local") if local else F.col("__utc")
    return at.between(rule[0] * 3600, rule[1] * 3600) if not isinstance(rule, int) else at == rule * 3600


def _clocks(df: DataFrame) -> DataFrame:
    utc = seconds_of_day(F.col("time"))
    return df.withColumn("__utc", utc).withColumn("__local", F.pmod(utc + utc_offset_hours(F.col("lon")) * 3600, F.lit(86400)))


def daily(df: DataFrame, rule: int | Sequence[int], variables: Sequence[str], local: bool = False, label: str = "utc", keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Daily values.  Two hours: means of the samples from the first to the second, both included; days
    without samples are left out.  One hour: the samples at that hour.  With ``local`` the hours are those
    of the longitude's band; the day stays that of UTC unless ``label`` is local."""
    day = F.to_date("time")
    if local and label == "local":
        day = F.to_date(F.col("time") + F.make_dt_interval(F.lit(0), utc_offset_hours(F.col("lon"))))
    own = _clocks(df).filter(in_hours(rule, local)).select(*keys, day.alias("day"), *variables)
    return own if isinstance(rule, int) else own.groupBy(*keys, "day").agg(*(F.avg(v).alias(v) for v in variables))


def daily_sections(df: DataFrame, sections: Sequence[Mapping], keys: Sequence[str] = ("lat", "lon"), static: Sequence[str] = ()) -> DataFrame:
    """Several daily rules for different variables, in one pass: each section has ``vars`` (names or a
    pattern), ``time`` (an hour or two) and ``local``.  Names that aren't there are skipped.  ``static`` variables
    have no time: each day of a cell has their value."""
    own, values = _clocks(df), {}
    for s in sections:
        for v in (c for k in ([s["vars"]] if isinstance(s["vars"], str) else s["vars"]) for c in matching(df, k)):
            if v in keys or v in static or v in ("time", "__utc", "__local"):
                continue
            value = F.when(in_hours(s["time"], s.get("local", False)), F.col(f"`{v}`"))
            values[v] = (F.max if isinstance(s["time"], int) else F.avg)(value).alias(v)
    return own.groupBy(*keys, F.to_date("time").alias("day")).agg(*values.values(), *(F.first(v, ignorenulls=True).alias(v) for v in static))


def resample(df: DataFrame, days: int, how: str, variables: Sequence[str], time: str = "time", keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Bins of ``days`` from midnight of the first sample of the cube; each cell has all bins."""
    first = df.agg(F.min(F.to_date(time)).alias("__first"), F.max(F.to_date(time)).alias("__last"))
    step = F.floor(F.datediff(F.to_date(time), F.col("__first")) / days)
    binned = df.crossJoin(F.broadcast(first)).select(*keys, F.date_add("__first", (step * days).cast("int")).alias("bin"), *variables)
    bins = first.select(F.explode(F.sequence("__first", "__last", F.expr(f"interval {days} days"))).alias("bin"))
    return _in_bins(df, binned, bins, how, variables, keys)


def _in_bins(df: DataFrame, binned: DataFrame, bins: DataFrame, how: str, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One value for each cell and bin; bins without samples are null, or 0 for sums and counts."""
    got = binned.groupBy(*keys, "bin").agg(*(REDUCERS[how](v).alias(v) for v in variables))
    out = df.select(*keys).distinct().crossJoin(F.broadcast(bins)).join(got, [*keys, "bin"], "left")
    return out.fillna(0, subset=list(variables)) if how in ("sum", "count") else out


def resample_hours(df: DataFrame, hours: int, how: str, variables: Sequence[str], time: str = "time", keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Bins of ``hours`` from midnight of the first sample of the cube to the last sample; each cell has all bins."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))  # noqa: E731  both sides in the session's zone
    midnight = F.date_trunc("day", F.col("__a")).cast("timestamp_ntz")
    ends = df.agg(F.min(time).cast("timestamp_ntz").alias("__a"), F.max(time).cast("timestamp_ntz").alias("__b")).select(midnight.alias("__first"), "__b")
    step = F.floor((seconds(F.col(time)) - seconds(F.col("__first"))) / (hours * 3600)) * hours
    at = lambda h: F.col("__first") + F.make_dt_interval(F.lit(0), h.cast("int"))
    binned = df.crossJoin(F.broadcast(ends)).select(*keys, at(step).alias("bin"), *variables)
    n = F.floor((seconds(F.col("__b")) - seconds(F.col("__first"))) / (hours * 3600))
    bins = ends.select("__first", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("__k")).select(at(F.col("__k") * hours).alias("bin"))
    return _in_bins(df, binned, bins, how, variables, keys)


def resample_calendar(df: DataFrame, unit: str, how: str, variables: Sequence[str], time: str = "time", keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Calendar months (labelled by their last day) or weeks (by their Sunday); each cell has all of them from the
    cube's first to its last."""
    start = lambda c: F.date_trunc(unit, c).cast("date")
    label = lambda c: F.last_day(c) if unit == "month" else F.date_add(c, 6)
    ends = df.agg(start(F.min(time)).alias("a"), start(F.max(time)).alias("b"))
    bins = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("s")).select(label(F.col("s")).alias("bin"))
    return _in_bins(df, df.select(*keys, label(start(F.col(time))).alias("bin"), *variables), bins, how, variables, keys)


def without_short_end(df: DataFrame, source: DataFrame, days: int, time: str = "time") -> DataFrame:
    """Resampled ``df`` without its last bin if the number of times in ``source`` isn't a multiple."""
    facts = source.agg((F.countDistinct(time) % days).alias("__rest")).crossJoin(df.agg(F.max("bin").alias("__end")))
    return df.crossJoin(F.broadcast(facts)).filter("__rest = 0 or bin < __end").drop("__rest", "__end")


def max_daily_mean(df: DataFrame, hours: int = 8, value: str = "value", keys: Sequence[str] = ("site",), inclusive: bool = False) -> DataFrame:
    """Daily maximum of forward means over ``hours``, inside the day.  The first window's number of samples
    is what all need; the first window with another number ends the day.  Samples without a value count as samples,
    and means are of those that have one."""
    span = f"{hours:02d}:00:00" if inclusive else f"{hours - 1:02d}:59:59.999999"
    own = df.withColumn("day", F.to_date("ts"))
    names, by = ", ".join(keys), ", ".join([*keys, "day"])
    frame = f"(partition by {by} order by ts range between current row and interval '{span}' hour to second following)"
    moving = own.selectExpr(*keys, "day", "ts", f"avg({value}) over {frame} as m", f"count(*) over {frame} as n")
    order = Window.partitionBy(*keys, "day").orderBy("ts")
    need = F.first("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stopped = F.max((F.col("n") != F.col("need")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = moving.withColumn("need", need).withColumn("stopped", stopped)
    return marked.groupBy(*keys, "day").agg(F.max(F.when(F.col("stopped") == 0, F.col("m"))).alias(f"mda{hours}"))


def rolling_daily_max(df: DataFrame, rows: int = 8, value: str = "value", keys: Sequence[str] = ("site",)) -> DataFrame:
    """Daily maximum of backward means over ``rows`` samples of a day; null with fewer."""
    order = Window.partitionBy(*keys, "day").orderBy("ts").rowsBetween(1 - rows, 0)
    own = df.withColumn("day", F.to_date("ts")).withColumn("m", F.when(F.count(value).over(order) == rows, F.avg(value).over(order)))
    return own.groupBy(*keys, "day").agg(F.max("m").alias(f"rolling{rows}"))


def every_nth_dropped(df: DataFrame, dim: str, n: int) -> DataFrame:
    """Without every n-th value (positions n, 2n, ...) of an axis; the axis values are numbered, not rows."""
    axis = df.select(dim).distinct().withColumn("__n", F.row_number().over(Window.orderBy(dim)))
    return df.join(F.broadcast(axis.filter(F.col("__n") % n != 0).select(dim)), dim, "left_semi")


def month_counts(df: DataFrame, variables: Sequence[str], time: str = "date") -> DataFrame:
    """Non-missing values of all variables in each calendar month, 0 in months without any."""
    month = F.trunc(time, "month")
    got = df.groupBy(month.alias("month")).agg(sum((F.count(v) for v in variables), F.lit(0)).alias("n"))
    ends = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(got, "month", "left").fillna(0, ["n"])
