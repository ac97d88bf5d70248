"""The whole way from files to explanations, and the streaming versions."""

from pyspark.sql import functions as F

from skymesh.operators import temporal
from skymesh.plans import workflow
from skymesh.plans.inputs import cube_hourly
from skymesh.streaming import daily as streaming

SF = "/root/testdata/sf0.01"


def test_files_to_explanations(spark, tmp_path):
    cube = cube_hourly(spark, SF).withColumn("y", F.col("gas_click") * 2 + F.col("gas_view"))
    years = F.explode(F.array(*(F.lit(y) for y in (2021, 2022, 2023))))
    many = cube.withColumn("year", years).withColumn("time", F.col("time") - F.make_ym_interval(F.lit(2024) - F.col("year")))
    many.repartition(2).write.partitionBy("year").parquet(str(tmp_path / "cube"))
    spec = workflow.Spec(target="y", globs=[str(tmp_path / "cube" / "year=202[1-3]")], variables=["gas_(click|view)"], sections=[{"vars": "gas_.*|y", "time": (0, 24)}])
    rows, features = workflow.load(spark, spec)
    assert features == ["gas_click", "gas_view"] and rows.count() == 1800
    scores = workflow.train(rows, features, [2021, 2022, 2030], str(tmp_path / "out"), "r1", numTrees=10, maxDepth=7)
    got = {r.fold_year: r for r in scores.collect()}
    assert set(got) == {2021, 2022} and all(r.r2 > 0.6 for r in got.values())
    again = {r.fold_year: r.r2 for r in workflow.rescore(spark, str(tmp_path / "out"), "r1").collect()}
    assert {k: round(v, 9) for k, v in again.items()} == {k: round(r.r2, 9) for k, r in got.items()}
    for mode in ("shap", "path"):
        whole = workflow.explain(spark, str(tmp_path / "out"), "r1", features, mode, work=str(tmp_path / mode))
        assert {c for c in whole.columns} == {"lat", "lon", "time", "fold_year", "feature", "shap_value", "feature_value", "base_value"}
        total = whole.groupBy("lat", "lon", "time").agg((F.sum("shap_value") + F.max("base_value")).alias("s"))
        stored = spark.read.parquet(str(tmp_path / "out" / "predict"))
        off = total.join(stored, ["lat", "lon", "time"]).agg(F.max(F.abs(F.col("s") - F.col("predict"))), F.count(F.lit(1))).first()
        assert off[0] < 1e-8 and off[1] == sum(r.n for r in got.values())


def test_streams_agree_with_tables(spark, tmp_path):
    cube = cube_hourly(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    cube.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cube.schema).parquet(str(tmp_path / "in"))
    query = streaming.daily(stream, (8, 15), ["gas_click"]).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    table = temporal.daily(cube, (8, 15), ["gas_click"])
    key = lambda df: sorted((r.lat, r.lon, str(r.day), None if r.gas_click is None else round(r.gas_click, 9)) for r in df.collect())
    assert [str(x) for x in key(spark.table("days"))] == [str(x) for x in key(table)]
    obs = cube.select("time", "lat", (F.col("lon") - 180).alias("lon"), F.col("gas_view").alias("value"))
    obs.write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "obs"))
    query = streaming.grid_counts(stream, [-40.0, 0.0], [0.0, 180.0]).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cells").agg(F.sum("n")).first()[0] == obs.filter("value is not null and lat >= -40").count()


def test_months_are_read_once_and_scored_by_what_is_stored(spark, tmp_path, monkeypatch):
    days = spark.range(0, 360, 3).select(F.col("id").alias("d")).crossJoin(spark.range(0, 3).select((F.col("id") * 10.0).alias("lat")))
    years = F.explode(F.array(*(F.lit(y) for y in (2021, 2022, 2023))))
    rows = days.withColumn("y", years).select("lat", (F.col("lat") + 5).alias("lon"), (F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)) + F.make_dt_interval(F.col("d").cast("int"))).alias("time"), F.sin(F.col("d") * 7 + F.col("y")).alias("a"), F.when(F.month(F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)) + F.make_dt_interval(F.col("d").cast("int"))) != 5, F.cos(F.col("d") * 3)).alias("b"))
    rows.withColumn("t", F.col("a") * 2 + F.coalesce("b", F.lit(0.0))).write.parquet(str(tmp_path / "cube"))
    spec = workflow.Spec(target="t", globs=[str(tmp_path / "cube")], variables=["a", "b"])
    reads, read = [], workflow.tables.read_cube
    monkeypatch.setattr(workflow.tables, "read_cube", lambda *a, **k: reads.append(a) or read(*a, **k))
    out = str(tmp_path / "out")
    scores = workflow.train_months(spark, spec, "3-5,8", [2021, 2022, 2023, 2024], out, "r", numTrees=3, maxDepth=4)
    got = {(r.month, r.fold_year): r for r in scores.collect()}
    assert len(reads) == 1 and set(got) == {(m, y) for m in ("mar", "apr", "may", "aug") for y in (2021, 2022, 2023)}
    stored = spark.read.parquet(f"{out}/predict").toPandas()
    for (month, year), r in got.items():
        own = stored[(stored.month == month) & (stored.fold_year == year)]
        e = own.target - own.predict
        assert len(own) == r.n and abs((e**2).mean() ** 0.5 - r.rmse) < 1e-9 and abs(1 - (e**2).sum() / ((own.target - own.target.mean()) ** 2).sum() - r.r2) < 1e-9
        assert set(own.time.dt.year) == {year} and len(set(own.time.dt.month)) == 1 and r.r2 > 0.5
    # a month without any value of a feature does without it
    assert stored[stored.month == "may"].b.isna().all() and stored[stored.month == "mar"].b.notna().all()
    one = workflow.train(*workflow.load(spark, workflow.replace(spec, month=8)), [2021, 2022, 2023], str(tmp_path / "one"), "r", "aug", numTrees=3, maxDepth=4)
    assert {r.fold_year: r.n for r in one.collect()} == {y: got["aug", y].n for y in (2021, 2022, 2023)}
    assert workflow.train_months(spark, workflow.Spec(target="t", globs=[str(tmp_path / "cube")], variables=["a"], ranges={"lat": (70, 80)}), "1", [2021], str(tmp_path / "none"), "r", numTrees=1) is None
