"""Alignment and conflicts of sources, pruned cubes, station files, the log of outputs, folds and densities."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymesh.operators import folds, report, select
from skymesh.sources import manifests, tables

CUBE = "lat double, lon double, time timestamp_ntz, a double"
T0, T1 = datetime(2020, 1, 5), datetime(2020, 7, 9, 12)


def test_conflicting_values_are_an_error_with_their_place(spark):
    one = spark.createDataFrame([(1.0, 2.0, T0, 5.0), (3.0, 2.0, T0, None)], CUBE)
    two = spark.createDataFrame([(1.0, 2.0, T0, 6.0), (3.0, 2.0, T0, 7.0)], CUBE)
    with pytest.raises(Exception, match=r"sources differ in a at lat = 1.0, lon = 2.0, time = 2020-01-05 00:00:00: 5.0 and 6.0"):
        tables.combine_by_coords([one, two]).collect()
    got = {r.lat: r.a for r in tables.combine_by_coords([one, two], conflicts="first").collect()}
    assert got == {1.0: 5.0, 3.0: 7.0}
    same = spark.createDataFrame([(1.0, 2.0, T0, 5.0), (9.0, 2.0, T0, 1.0)], CUBE)
    assert sorted((r.lat, r.a) for r in tables.combine_by_coords([one, same]).collect()) == [(1.0, 5.0), (3.0, None), (9.0, 1.0)]
    assert [(r.lat, r.low, r.high) for r in tables.conflicts_of([one, two]).collect()] == [(1.0, 5.0, 6.0)]
    cells = spark.createDataFrame([(1.0, 2.0, 10.0)], "lat double, lon double, people double")
    more = spark.createDataFrame([(3.0, 2.0, 20.0), (1.0, 2.0, 10.0)], "lat double, lon double, people double")
    assert sorted((r.lat, r.people) for r in tables.combine_by_coords([one, cells, more]).collect()) == [(1.0, 10.0), (3.0, 20.0)]


def test_files_that_two_globs_match_are_read_once(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([(float(k), 2.0, T0, float(k))], CUBE).write.parquet(str(tmp_path / f"x{k}"))
    for disjoint in (False, True):
        got = tables.read_cube(spark, str(tmp_path / "x*"), str(tmp_path / "x1"), str(tmp_path / "x[1-2]"), disjoint=disjoint)
        assert sorted(r.lat for r in got.collect()) == [1.0, 2.0]


def test_stored_tiles_prune_files(spark, tmp_path):
    rows = [(float(a), float(o), t, 1.0) for a in range(-85, 90, 10) for o in range(-175, 180, 10) for t in (T0, T1)]
    df = spark.createDataFrame(rows, CUBE)
    tables.save_cube(df, str(tmp_path / "cube"))
    cube = tables.read_cube(spark, str(tmp_path / "cube"))
    box = {"Europe": select.REGIONS["Europe"], "wrapped": {"lat": (-90, -80), "lon": (170, 180)}}
    for own, want, filters in (
        (select.sel_month(cube, 7), df.filter("month(time) = 7"), "part_month"),
        (select.sel_regions(cube, box, dropna=False), select.sel_regions(df, box, dropna=False), "part_tile"),
        (select.sel_range(select.sel_range(cube, "lat", (0, 20)), "lon", (-20, 30)), df.filter("lat between 0 and 20 and lon between -20 and 30"), "part_tile"),
    ):
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert filters in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
        read = own.select(F.input_file_name()).distinct().count()
        assert 0 < read <= len(cube.inputFiles()) / 2
        assert sorted(own.select("lat", "lon", "time").collect()) == sorted(want.select("lat", "lon", "time").collect())


def test_tiles_of_a_box_hold_all_its_places():
    for lat, lon in (((-90, 90), (-180, 180)), ((10, 40), (350, 380)), ((-5, 5), (-10, 25)), ((90, 90), (0, 0)), ((0, 30), (179, 181))):
        tiles = set(select.tiles_in(lat, lon))
        for a in np.linspace(*lat, 13):
            for o in np.linspace(*lon, 13):
                assert select.interleaved(int((a + 90) // 30), int((o % 360) // 30)) in tiles


def test_station_files_lose_only_what_cant_be_read(spark, tmp_path):
    meta = '"metadata": {"network_name": "n", "station_id": "s", "station_lon": 1, "station_lat": 2}'
    for name, text in {
        "nan": '{"datetime": ["2020-01-01", "2020-01-02", "2020-01-03"], "mean": [NaN, 1.5, -Infinity], "note": "[NaN, NaN]", %s}' % meta,
        "bad": '{"datetime": ["2020-01-01", "someday", null, "2020-01-04"], "mean": ["x", 2, 3, {"a": 1}], %s}' % meta,
        "broken": '{"datetime": [', "short": '{"datetime": [], "mean": []}', "scalar": '{"datetime": "2020", "mean": 3, %s}' % meta,
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, report_ = tables.read_station_json(spark, str(tmp_path))
    got = sorted(((str(r.datetime)[:10], r["mean"]) for r in rows.collect()), key=str)
    assert got == sorted([("2020-01-01", None), ("2020-01-02", 1.5), ("2020-01-03", None), ("2020-01-01", None), ("2020-01-04", None)], key=str)
    assert tuple(report_.first()) == (5, 1, 1)
    files = {r.file.rsplit("/", 1)[1]: (r.status, r.lost_values, r.lost_dates) for r in tables.station_files(spark, str(tmp_path)).collect()}
    assert files["nan.json"] == ("read", 0, 0)
    assert files["bad.json"] == ("read", 2, 2) and files["broken.json"][0] == "unparsed" and files["short.json"][0] == "short"


def test_a_failed_input_stays_unwritten(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    inputs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "input string, fingerprint string")
    calls = []

    def process(name, bad=()):
        calls.append(name)
        if name in bad:
            raise ValueError("no such thing")
        return spark.range(3 if name == "a" else 2)

    first = manifests.refresh(spark, inputs, lambda n: process(n, "b"), out, log)
    assert {(r.input, r.status, r.rows) for r in first.collect()} == {("a", "ok", 3), ("b", "failed", 0), ("c", "ok", 2)}
    assert first.filter("input = 'b'").first().message == "no such thing"
    assert [r.input for r in manifests.unwritten(inputs, spark, log).collect()] == ["b"]
    changed = inputs.withColumn("fingerprint", F.when(F.col("input") == "c", "2").otherwise("1"))
    manifests.refresh(spark, changed, process, out, log)
    assert calls == ["a", "b", "c", "b", "c"] and manifests.unwritten(changed, spark, log).isEmpty()
    manifests.refresh(spark, changed, process, out, log)
    assert len(calls) == 5
    assert {(r.input, r["count"]) for r in spark.read.parquet(out).groupBy("input").count().collect()} == {("a", 3), ("b", 2), ("c", 2)}
    manifests.refresh(spark, changed, process, out, log, regenerate=True)
    assert len(calls) == 8 and spark.read.parquet(out).count() == 7


@pytest.mark.parametrize("parts", [1, 5])
def test_shuffled_folds_are_the_same_for_any_partitioning(spark, parts):
    df = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else None) for i in range(103)], "id int, k string").repartition(parts)
    got = {r.id: r.fold for r in folds.shuffled_folds(df, 5, ["id", "k"], seed=3).collect()}
    sizes = [list(got.values()).count(f) for f in range(5)]
    assert sizes == [21, 21, 21, 20, 20]
    again = {r.id: r.fold for r in folds.shuffled_folds(df.orderBy(F.desc("id")), 5, ["id", "k"], seed=3).collect()}
    other = {r.id: r.fold for r in folds.shuffled_folds(df, 5, ["id", "k"], seed=4).collect()}
    assert got == again and got != other and got != {i: min(i // 21, 4) for i in range(103)}


def test_kernel_density_is_within_its_error(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(30, 0.1, (20, 2)), [[1e3, -1e3]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(-1, None, 2.0)], "k int, x double, y double")
    for h, fine, cut in ((0.7, 8, 4), (2.0, 16, 3)):
        got = {r.k: r.density for r in report.kernel_density(df, ["k"], h, "x", "y", fine, cut).collect()}
        near = ((x[:, None] - x[None]) ** 2).sum(2)
        want = np.exp(-near / (2 * h * h)).mean(1) / (2 * math.pi * h * h)
        error = (1 / (2 * fine**2) + 2 * math.exp(-(cut**2) / 2)) / (2 * math.pi * h * h)
        assert set(got) == set(range(len(x))) and max(abs(got[i] - want[i]) for i in got) <= error
