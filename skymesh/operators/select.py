"""Choice of columns and rows of a cube: variables, ranges, dates, regions, cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.functions.columns import column_of, formula, matching

#: latitude and longitude bounds of the named regions (fixed values)
REGIONS = {
    "NorthAmerica": {"lat": (20, 55), "lon": (-125, -70)},
    "Europe": {"lat": (35, 65), "lon": (-10, 25)},
    "Asia": {"lat": (20, 50), "lon": (100, 145)},
}
KEYS = ("lat", "lon", "time")
#: partition columns of a cube stored by ``tables.save_cube``; selections use them where they are there
PARTS = ("part_year", "part_month", "part_tile")
TILE = 30.0


def interleaved(i, j, bits: int = 8):
    """The Z-order of two small numbers, or columns of them: their bits by turns."""
    out = None
    for k in range(bits):
        for m, x in enumerate((j, i)):
            bit = ((x >> k) & 1) << (2 * k + m) if isinstance(x, int) else F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k + m)
            out = bit if out is None else out + bit
    return out


def tile_of(lat, lon, degrees: float = TILE):
    """The tile of a place, in Z-order; either convention of longitudes."""
    return interleaved(F.floor((lat + 90) / degrees).cast("int"), F.floor(F.pmod(lon, F.lit(360.0)) / degrees).cast("int"))


def tiles_in(lat: Sequence[float] = (-90, 90), lon: Sequence[float] = (-180, 360), degrees: float = TILE) -> list[int]:
    """The tiles that a box may touch."""
    (south, north), (west, east) = sorted(lat), sorted(lon)
    rows = range(int((south + 90) // degrees), int((north + 90) // degrees) + 1)
    round_ = int(-(-360 // degrees))
    whole = east - west >= 360 - degrees
    columns = range(round_) if whole else {k % round_ for k in range(int((west % 360) // degrees), int((west % 360 + east - west) // degrees) + 1)}
    return sorted({interleaved(max(0, i), j) for i in rows for j in columns})


def _pruned(df: DataFrame, boxes: Sequence[Mapping[str, Sequence]]) -> DataFrame:
    if "part_tile" not in df.columns:
        return df
    return df.filter(F.col("part_tile").isin(sorted({t for b in boxes for t in tiles_in(**{d: v for d, v in b.items() if d in ("lat", "lon")})})))


def select_vars(df: DataFrame, wanted: Sequence[str] | str, target: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Key columns and the wanted variables (exact names or patterns); what the target needs stays."""
    names = [c for w in ([wanted] if isinstance(wanted, str) else wanted) for c in matching(df, w)]
    if target:
        names += [column_of(target, df.columns)] if column_of(target, df.columns) in df.columns else formula(target, df.columns)[1]
    keep = [c for c in df.columns if c in keys or c in names or c in PARTS]
    return df.select(*(f"`{c}`" for c in keep))


def sel_range(df: DataFrame, dim: str, bounds: Sequence) -> DataFrame:
    """Rows with ``dim`` inside the bounds, both included, in whatever order they are given."""
    if len(bounds) != 2:
        raise ValueError(f"a range has two bounds, not {len(bounds)}")
    low, high = sorted(bounds)
    return (_pruned(df, [{dim: (low, high)}]) if dim in ("lat", "lon") else df).filter(F.col(dim).between(low, high))


def sel_value(df: DataFrame, dim: str, value) -> DataFrame:
    return df.filter(F.col(dim) == value)


def sel_month(df: DataFrame, month: int, time: str = "time") -> DataFrame:
    own = df.filter(F.col("part_month") == month) if "part_month" in df.columns else df
    return own.filter(F.month(time) == month)


def drop_date(df: DataFrame, year: int | None = None, month: int | None = None, day: int | None = None, time: str = "time") -> DataFrame:
    """Without the rows that have all of the given date parts."""
    parts = [f(time) == v for f, v in ((F.year, year), (F.month, month), (F.day, day)) if v is not None]
    return df.filter(~reduce(lambda a, b: a & b, parts)) if parts else df


def in_box(box: Mapping[str, Sequence]):
    return reduce(lambda a, b: a & b, (F.col(d).between(*sorted(b)) for d, b in box.items()))


def sel_regions(df: DataFrame, regions: Mapping[str, Mapping[str, Sequence]], dropna: bool = True) -> DataFrame:
    """Rows in any of the boxes, each once; without those that lack a value."""
    out = _pruned(df, list(regions.values())).filter(reduce(lambda a, b: a | b, map(in_box, regions.values())))
    return out.dropna("any") if dropna else out


def sel_cells(df: DataFrame, cells: DataFrame, remove: bool = False, keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Rows at (or, with ``remove``, not at) the given cells."""
    return df.join(cells.select(*keys).distinct(), list(keys), "left_anti" if remove else "left_semi")


def cells_with(df: DataFrame, variable: str, keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """The cells at which a variable is ever present."""
    return df.filter(F.col(f"`{variable}`").isNotNull()).select(*keys).distinct()


def drop_incomplete(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    return df.dropna("any", subset=[*features, *([target] if target else [])])


def nearest_coord(df: DataFrame, dim: str, value: float) -> DataFrame:
    """The coordinate nearest to ``value``, the lesser of two."""
    return df.agg(F.min(F.struct(F.abs(F.col(dim) - value).alias("d"), F.col(dim).alias("v")))["v"].alias(dim))


def point_series(df: DataFrame, lat: float, lon: float, variable: str) -> DataFrame:
    return df.filter((F.col("lat") == lat) & (F.col("lon") == lon)).select("time", f"`{variable}`").orderBy("time")


def with_target(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """``target`` is a column, or a formula whose inputs are then dropped from the features."""
    if column_of(target, df.columns) in df.columns:
        return df.withColumnRenamed(column_of(target, df.columns), "target")
    value, names = formula(target, df.columns)
    return df.withColumn("target", value).drop(*names)


def with_calculated(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """New columns by formulas, in order: a later one may use an earlier one."""
    for name, text in formulas.items():
        df = df.withColumn(name, formula(text, df.columns)[0])
    return df
