"""Edge rules of the operators on small frames."""

import itertools
from datetime import datetime, timedelta
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymesh.functions import columns as fn
from skymesh.operators import attribution, folds, forest, grid, report, reshape, select, stats, temporal, trees
from skymesh.plans.inputs import FEATURES, ROW_KEY, TINY_FOREST, ml_rows, tiny_forest
from skymesh.sources import manifests, tables

SF = "/root/testdata/sf0.001"


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, 0.0)], "k int, x double")
    assert values(fn.all_finite(df, ["x"]).filter("x is null"), "k") == [(1,), (2,), (3,), (4,)]


def test_replace_values_keeps_null_unless_asked(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0), (4, 2.1)], "k int, x double")
    assert values(df.select("k", fn.replace_values("x", 1, 2, 0.0).alias("x")).filter("x = 0"), "k") == [(2,), (3,)]
    assert values(df.select("k", fn.replace_values("x", 1, 2, 0.0, replace_null=True).alias("x")).filter("x = 0"), "k") == [(1,), (2,), (3,)]


def test_formula_is_arithmetic_only(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0)], "a double, b double")
    col, names = fn.formula("2 * (a) / (b) + 1")
    assert names == ["a", "b"]
    assert [r[0] for r in df.select(col).collect()] == [5.0, None]
    for bad in ("(a) + current_user()", "(a); drop", "1 + 1"):
        with pytest.raises(ValueError):
            fn.formula(bad)


def test_longitudes_and_bands(spark):
    df = spark.createDataFrame([(0.0,), (7.5,), (7.4,), (180.0,), (352.5,), (352.4,), (187.5,)], "lon double")
    got = {r.lon: (r.s, r.o) for r in df.select("lon", fn.to_signed(F.col("lon")).alias("s"), fn.utc_offset_hours(F.col("lon")).alias("o")).collect()}
    assert got[0.0] == (0.0, 0) and got[7.5][1] == 1 and got[7.4][1] == 0
    assert got[180.0] == (-180.0, -12) and got[187.5][1] == -11
    assert got[352.5][1] == 0 and round(got[352.4][0], 6) == -7.6 and got[352.4][1] == -1


def test_column_patterns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "lat int, gas_a int, gas_mda8 int, x int")
    assert fn.matching(df, "gas_(?!mda8).*") == ["gas_a"]
    assert select.select_vars(df, ["x"], target="(gas_a) - (gas_mda8)").columns == ["lat", "gas_a", "gas_mda8", "x"]


def test_ranges_are_inclusive_in_any_order(spark):
    df = spark.range(6).withColumnRenamed("id", "lat")
    assert values(select.sel_range(df, "lat", (4, 2)), "lat") == [(2,), (3,), (4,)]
    with pytest.raises(ValueError):
        select.sel_range(df, "lat", (1, 2, 3))


def test_edges_of_bins(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (19.9,), (20.0,), (20.1,)], "x double")
    got = [r[0] for r in df.select(fn.edge_index(F.col("x"), [0, 10, 20])).collect()]
    assert got == [None, 0, 1, 1, 1, None]


def test_grid_labels_and_dense_cells(spark):
    obs = spark.createDataFrame([("2024-01-01", 90.0, -180.0, 1.0), ("2024-01-01", 85.0, -170.0, 3.0), ("2024-01-01", -5.0, 0.0, 9.0)], "date string, lat double, lon double, value double").withColumn("date", F.to_date("date"))
    got = grid.match_to_grid(obs, [0.0, 45.0], [0.0, 180.0], ["mean", "count"])
    assert values(got, "lat", "lon", "obs_mean", "obs_count") == [(45.0, 0.0, 2.0, 2)]
    full = grid.dense(got, obs, [0.0, 45.0], [0.0, 180.0], ["obs_count"])
    assert full.count() == 4 and full.filter("obs_count = 0 and obs_mean is null").count() == 3
    with pytest.raises(ValueError):
        grid.match_to_grid(obs, [0.0], [0.0], ["mode"])


def test_hours_are_inclusive(spark):
    rows = [(0.0, 0.0, datetime(2024, 1, 1, h, m, s), v) for h, m, s, v in ((7, 59, 59, 1.0), (8, 0, 0, 2.0), (15, 0, 0, 4.0), (15, 0, 1, 8.0))]
    df = spark.createDataFrame(rows, "lat double, lon double, time timestamp_ntz, x double")
    assert values(temporal.daily(df, (8, 15), ["x"]), "x") == [(3.0,)]
    assert values(temporal.daily(df, 8, ["x"]), "x") == [(2.0,)]


def test_local_hours_keep_the_utc_day_unless_asked(spark):
    df = spark.createDataFrame([(0.0, 150.0, datetime(2024, 1, 1, 23), 5.0)], "lat double, lon double, time timestamp_ntz, x double")  # 09:00 on the second, local
    assert values(temporal.daily(df, (8, 15), ["x"], local=True).withColumn("day", F.col("day").cast("string")), "day") == [("2024-01-01",)]
    assert values(temporal.daily(df, (8, 15), ["x"], local=True, label="local").withColumn("day", F.col("day").cast("string")), "day") == [("2024-01-02",)]


def mda_by_loop(times, x, hours=8):
    need, out = None, []
    for t in times:
        own = [v for u, v in zip(times, x, strict=True) if t <= u < t + timedelta(hours=hours)]
        if need is None:
            need = len(own)
        if len(own) != need:
            break
        out.append(sum(own) / len(own))
    return max(out)


@pytest.mark.parametrize("hours", [list(range(24)), [h for h in range(24) if h != 10], [0, 1, 2, 5, 9, 12, 23]])
def test_mda8_stops_at_the_first_short_window(spark, hours):
    times = [datetime(2024, 1, 1, h) for h in hours]
    x = [float((h * 7) % 11) for h in hours]
    df = spark.createDataFrame([("a", t, v) for t, v in zip(times, x, strict=True)], "site string, ts timestamp_ntz, value double")
    assert temporal.max_daily_mean(df).first().mda8 == pytest.approx(mda_by_loop(times, x))


def test_resample_anchors_at_the_first_day_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 0.0, datetime(2024, 1, 2, 5), 1.0), (0.0, 0.0, datetime(2024, 1, 9), 3.0)], "lat double, lon double, time timestamp_ntz, x double")
    mean = temporal.resample(df, 3, "mean", ["x"]).withColumn("bin", F.col("bin").cast("string"))
    assert values(mean, "bin") == [("2024-01-02",), ("2024-01-05",), ("2024-01-08",)] and mean.filter("x is null").count() == 1
    assert values(temporal.resample(df, 3, "sum", ["x"]), "x") == [(0.0,), (1.0,), (3.0,)]


def test_every_nth_and_month_counts(spark):
    df = spark.range(10).withColumnRenamed("id", "lat")
    assert values(temporal.every_nth_dropped(df, "lat", 3), "lat") == [(0,), (1,), (3,), (4,), (6,), (7,), (9,)]
    obs = spark.createDataFrame([("2024-01-05", 1.0), ("2024-03-01", None)], "date string, x double").withColumn("date", F.to_date("date"))
    assert [r.n for r in temporal.month_counts(obs, ["x"]).orderBy("month").collect()] == [1, 0, 0]


def test_merge_counts_conflicts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "lat int, x double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "lat int, x double")
    assert values(reshape.merge(a, b, ["lat"]), "lat", "x", "conflicts") == [(1, 1.0, 1), (2, 6.0, 0), (3, 7.0, 0)]


def test_block_folds_sizes(spark):
    df = spark.range(10).withColumn("b", F.col("id") % 2)
    sizes = folds.block_folds(df, 3, ["id"], ["b"]).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3]


def test_months():
    assert folds.months("1-12:2") == [1, 3, 5, 7, 9, 11] and folds.months("1,3,5-6") == [1, 3, 5, 6]


def test_zscore_of_constant_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, x double")
    assert [r.x for r in stats.zscore(df, ["x"]).collect()] == [None, None]


def test_interval_quantiles():
    assert forest.interval_quantiles([90, 0]) == [0.05, 0.5, 0.95]


def test_estimator_names():
    with pytest.raises(ValueError):
        forest.estimator("AdaBoostRegressor")


def test_prepare_reports_empty_features(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (float("inf"), None, 2.0)], "a double, b double, target double")
    rows, empty = forest.prepare(df, ["a", "b"])
    assert empty == ["b"] and rows.count() == 1
    assert forest.prepare(df.limit(0), ["a", "b"])[0] is None


def brute_shapley(tree, x):
    nodes = {r[1]: r for r in tree}

    def value(node, known):
        _, _, v, cover, f, t, left, right = nodes[node]
        if f < 0:
            return v
        if f in known:
            return value(left if x[f] <= t else right, known)
        return (value(left, known) * nodes[left][3] + value(right, known) * nodes[right][3]) / cover

    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                out[i] += factorial(k) * factorial(n - 1 - k) / factorial(n) * (value(0, {*s, i}) - value(0, {*s}))
    return out, value(0, set())


def flat(tree):
    columns = dict(zip(["tree", "node", "value", "cover", "feature", "threshold", "left", "right"], zip(*tree, strict=True), strict=True))
    return trees.Tree.of(*(np.array([np.nan if v is None else v for v in columns[c]], float if c in ("threshold", "value", "cover") else np.int64) for c in trees.COLUMNS))


def random_tree(rng, features, depth):
    rows, todo, n = [], [(0, 0, 1000.0)], 1
    while todo:
        node, level, cover = todo.pop()
        if level == depth or cover < 2 or (level and rng.random() < 0.15):
            rows.append((0, node, float(rng.normal()), cover, -1, None, -1, -1))
            continue
        part = round(cover * rng.uniform(0.1, 0.9), 3)
        rows.append((0, node, float(rng.normal()), cover, int(rng.integers(features)), float(rng.uniform(0, 1)), n, n + 1))
        todo += [(n, level + 1, part), (n + 1, level + 1, cover - part)]
        n += 2
    return rows


@pytest.mark.parametrize("features,depth,patterns", [(3, 5, 6), (3, 5, 0), (6, 5, 6), (6, 5, 0), (8, 6, 6), (2, 7, 0)])
def test_both_ways_to_shapley_values_are_brute_force(monkeypatch, features, depth, patterns):
    monkeypatch.setattr(trees, "PATTERNS", patterns)
    rng = np.random.default_rng(features + depth)
    for _ in range(3):
        tree = random_tree(rng, features, depth)
        own = flat(tree)
        x = rng.uniform(-0.2, 1.2, (4, features))
        x[0, 0] = np.nan
        got = own.shapley(x)
        for i, row in enumerate(np.where(np.isnan(x), np.inf, x)):
            want, base = brute_shapley(tree, row)
            assert np.allclose(got[i], want, atol=1e-12) and np.isclose(base, own.expected())
            assert np.isclose(got[i].sum() + base, own.value[own.reached(x[i : i + 1])[0]])


def test_a_forest_in_parts_gives_the_same(spark):
    rng = np.random.default_rng(7)
    rows = [(t, *r[1:]) for t in range(5) for r in random_tree(rng, 4, 5)]
    nodes = spark.createDataFrame(rows, attribution.NODES)
    df = spark.createDataFrame([(i, *map(float, rng.uniform(0, 1, 4))) for i in range(50)] + [(50, None, 0.5, float("nan"), 0.1)], "k int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    for f in (attribution.tree_shap, attribution.interpret_rows):
        whole, parted = (f(df, nodes, names, ["k"], most=m) for m in (1 << 20, 10))
        key = lambda r: (r.k, getattr(r, "feature", ""))
        for a, b in zip(sorted(whole.collect(), key=key), sorted(parted.collect(), key=key), strict=True):
            flat_ = lambda r: [x for v in r if not isinstance(v, str) for x in (v if isinstance(v, list) else [np.nan if v is None else v])]
            assert np.allclose(flat_(a), flat_(b), equal_nan=True)
    assert "Exchange" not in attribution.interpret_rows(df, nodes, names, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_tree_shap_is_brute_force_shapley():
    tree = [(0, 0, 0, 100.0, 0, 1.0, 1, 2), (0, 1, 0, 60.0, 1, 2.0, 3, 4), (0, 2, 9.0, 40.0, -1, None, -1, -1), (0, 3, 1.0, 20.0, -1, None, -1, -1), (0, 4, 0, 40.0, 2, 0.5, 5, 6), (0, 5, 5.0, 10.0, -1, None, -1, -1), (0, 6, 0, 30.0, 0, 0.2, 7, 8), (0, 7, 2.0, 12.0, -1, None, -1, -1), (0, 8, 3.0, 18.0, -1, None, -1, -1)]

    own = flat(tree)
    x = np.array([[0.1, 3.0, 1.0], [0.5, 1.0, 0.0], [2.0, 2.0, 0.5], [0.2, 2.5, 0.4]])
    got, base = own.shapley(x), own.expected()
    for i, row in enumerate(x):
        want, b = brute_shapley(tree, row)
        assert np.allclose(got[i], want) and np.isclose(base, b)


@pytest.fixture(scope="module")
def fitted(spark):
    rows, _ = forest.prepare(ml_rows(spark, SF), FEATURES)
    rows = rows.cache()
    return rows, forest.estimator(numTrees=4, maxDepth=4).fit(rows.filter("year <> 1998"))


def test_attribution_adds_up(spark, fitted, tmp_path):
    rows, model = fitted
    test = rows.filter("year = 1998")
    nodes = attribution.node_table(model, str(tmp_path / "forest"))
    whole = attribution.interpret(forest.leaves(model, test, ROW_KEY), attribution.leaf_paths(nodes, len(FEATURES)), ROW_KEY, len(FEATURES))
    long = attribution.long_contributions(whole, ROW_KEY)
    both = whole.join(long.groupBy(*ROW_KEY).agg(F.sum("contribution").alias("c")), ROW_KEY).join(model.transform(test).select(*ROW_KEY, F.col("predict").alias("p")), ROW_KEY)
    facts = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("bias") - F.col("c"))).alias("off"), F.max(F.abs(F.col("p") - F.col("predict"))).alias("same")).first()
    assert facts.n == test.count() and facts.off < 1e-8 and facts.same < 1e-8
    mapped = attribution.interpret_rows(test, nodes, FEATURES, ROW_KEY).select(*ROW_KEY, F.col("predict").alias("m"), F.col("bias").alias("mb"), F.col("contributions").alias("mc"))
    apart = mapped.join(whole, ROW_KEY).agg(F.max(F.abs(F.col("m") - F.col("predict"))), F.max(F.abs(F.col("mb") - F.col("bias"))), F.max(F.aggregate(F.zip_with("mc", "contributions", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b))).first()
    assert max(apart) < 1e-8
    shap = attribution.tree_shap(test, nodes, FEATURES, ROW_KEY).groupBy(*ROW_KEY).agg((F.sum("shap_value") + F.max("base_value")).alias("s"))
    assert shap.join(both, ROW_KEY).agg(F.max(F.abs(F.col("s") - F.col("p")))).first()[0] < 1e-8


def test_scores_and_quantiles_are_sound(spark, fitted):
    rows, model = fitted
    test = model.transform(rows.filter("year = 1998"))
    assert stats.scores(test).first().r2 > 0.9
    reach = forest.leaf_arrays(model, rows.filter("year = 1998"), ROW_KEY)
    q = forest.quantiles(forest.leaf_arrays(model, rows.filter("year <> 1998"), ["target"]), reach, ROW_KEY, [0.05, 0.5, 0.95])
    inside = q.join(rows, ROW_KEY).agg(F.avg((F.col("target").between(F.col("q_0_05"), F.col("q_0_95"))).cast("int"))).first()[0]
    assert inside > 0.8 and q.filter("q_0_05 > q_0_5 or q_0_5 > q_0_95").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000, 4097])
def test_each_repeat_is_a_permutation_of_its_own(n):
    orders = [trees.permuted(np.arange(n), n, key) for key in (1, 2, 3)]
    assert all(sorted(x.tolist()) == list(range(n)) for x in orders)
    if n >= 64:
        assert len({tuple(x) for x in orders}) == 3 and (np.diff(orders[0]) % n != np.diff(orders[0])[0] % n).any()


def test_permutation_importance_by_hand(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(t, *r[1:]) for t in range(3) for r in random_tree(rng, 3, 3)], attribution.NODES)
    forest_ = [t for lot in trees.parts(nodes) for t in lot]
    x, y = rng.uniform(0, 1, (40, 3)), rng.normal(size=40)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, target double")
    got = {r.feature: (r.importance, r.std) for r in trees.permutation_importance(df, nodes, ["a", "b", "c"], ["k"], repeats=3, seed=5).collect()}
    order, n = trees.numbered(df, ["k"], 5, ["k"])
    at = np.array([r.at for r in order.orderBy("k").collect()])
    assert n == 40 and sorted(at.tolist()) == list(range(40))
    predict = lambda v: np.mean([t.value[t.reached(v)] for t in forest_], 0)
    r2 = lambda v: 1 - ((y - predict(v)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    drops = []
    for key in np.random.default_rng(5).integers(1, 2**31, 3):
        source = np.empty(40, np.int64)
        source[trees.permuted(at, 40, int(key))] = np.arange(40)  # the row that comes to a place
        for j in range(3):
            v = x.copy()
            v[:, j] = x[source[at], j]
            drops.append(r2(x) - r2(v))
    drops = np.array(drops).reshape(3, 3)
    for j, f in enumerate("abc"):
        assert np.allclose(got[f], (drops[:, j].mean(), drops[:, j].std()))


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 100])
def test_leaf_caps_open_the_best_split_first(spark, cap):
    rng = np.random.default_rng(11)
    rows = [(t, *r[1:]) for t in range(4) for r in random_tree(rng, 3, 5)]
    got = trees.leaf_capped(spark.createDataFrame(rows, attribution.NODES), cap).toPandas()
    for t in range(4):
        own = {r[1]: r for r in rows if r[0] == t}
        gain = lambda n, own=own: sum(own[c][3] * (own[c][2] - own[n][2]) ** 2 for c in own[n][6:8])
        leaves = [0]
        while len(leaves) < cap and any(own[n][4] >= 0 for n in leaves):
            best = max((n for n in leaves if own[n][4] >= 0), key=gain)
            leaves.remove(best)
            leaves += own[best][6:8]
        mine = got[got.tree == t]
        assert sorted(mine[mine.feature < 0].value) == sorted(own[n][2] for n in leaves)
        assert len(mine) == 2 * len(leaves) - 1


def test_permutation_importance_finds_the_price(spark, fitted, tmp_path):
    rows, model = fitted
    got = trees.permutation_importance(rows.filter("year = 1998"), attribution.node_table(model, str(tmp_path / "forest")), FEATURES, ROW_KEY, repeats=2)
    assert got.orderBy(F.desc("importance")).first().feature == "l_extendedprice"


def test_year_folds_cover_each_row_once(spark, fitted):
    rows, _ = fitted
    n = sum(p.count() for _, _, p in forest.by_year(rows, range(1995, 2002), numTrees=1, maxDepth=2))
    assert n == rows.count()


def test_leaf_order_of_the_small_forest(spark):
    paths = attribution.leaf_paths(tiny_forest(spark), 2)
    assert values(paths, "tree", "leaf", "value") == sorted((t, k, v) for t in (0, 1) for k, v in enumerate(r[2] for r in TINY_FOREST if r[0] == t and r[4] < 0))


def test_waterfall_puts_the_rest_together(spark):
    df = spark.createDataFrame([(1, f, v, 0.0, 10.0) for f, v in (("a", 1.0), ("b", -5.0), ("c", 2.0), ("d", 0.5))], "k int, feature string, shap_value double, feature_value double, base_value double")
    got = report.waterfall(df, ["k"], most=3).orderBy("rank").collect()
    assert [(r.feature, r.upto) for r in got] == [("b", 5.0), ("c", 7.0), ("other", 8.5)]


def test_station_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"datetime": ["2024-01-01 00:00", "2024-01-01 01:00"], "mean": [1.5, null], "metadata": {"network_name": "n", "station_id": "s", "station_lon": 1.0, "station_lat": 2.0}}')
    (tmp_path / "bad.json").write_text('{"datetime": ["2024-01-')
    (tmp_path / "short.json").write_text('{"datetime": [], "mean": []}')
    rows, report_ = tables.read_station_json(spark, str(tmp_path))
    assert values(rows.filter("mean is not null"), "network", "station", "mean") == [("n", "s", 1.5)] and rows.count() == 2
    assert tuple(report_.first()) == (3, 1, 1)


def test_missing_files_and_objects(spark, tmp_path):
    assert tables.read_cube(spark, str(tmp_path / "none*.parquet")) is None
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, x double")
    where = {"run": "r1", "month": "jan", "fold_year": 2011, "kind": "test"}
    assert tables.save_objects(str(tmp_path / "out"), where, ["predict", "target"], predict=df, target=None) == ["predict"]
    got = tables.load_objects(spark, str(tmp_path / "out"), ["predict", "explanation"], run="r1")
    assert got["explanation"] is None and got["predict"].count() == 1
    assert [tuple(r) for r in tables.folds_of(got["predict"]).select("month_no", "fold_year").collect()] == [(1, 2011)]


def test_variable_names_of_files(spark):
    df = spark.createDataFrame([("/a/b/2011_2dsfc_BrONO2.nc",), ("x_t.parquet",)], "p string")
    assert [r[0] for r in df.select(tables.variable_of_file(F.col("p"))).collect()] == ["2dsfc/BrONO2", "t"]


def test_plan_and_pending(spark):
    s = spark.createDataFrame([(1, "a", "x"), (2, "ab", "y"), (3, "a", "z")], "id int, network_name string, station_id string")
    have = spark.createDataFrame([(3,)], "id int")
    net = spark.createDataFrame([("a",)], "network_name string")
    assert values(manifests.plan(s, net, None, have), "id") == [(1,)]
    assert values(manifests.plan(s, net, None, have, overwrite=True), "id") == [(1,), (3,)]
    assert values(manifests.pending(s, have, "id"), "id") == [(1,), (2,)]


def test_quantiles_are_exact(spark):
    """Of many different targets, by brute force, with few and many bins."""
    rng = np.random.default_rng(4)
    target, leaf = rng.normal(size=400), rng.integers(0, 4, (400, 3))
    reach = rng.integers(0, 4, (30, 3))
    samples = spark.createDataFrame([(leaf[i].tolist(), float(target[i])) for i in range(400)], "leaves array<int>, target double")
    reached = spark.createDataFrame([(k, reach[k].tolist()) for k in range(30)], "k int, leaves array<int>")
    order = np.argsort(target)
    for bins in (1, 2, 50):
        for r in forest.quantiles(samples, reached, ["k"], [0.05, 0.5, 0.95], bins=bins).collect():
            w = sum((leaf[:, t] == reach[r.k, t]) / (leaf[:, t] == reach[r.k, t]).sum() for t in range(3))[order] / 3
            assert [r.q_0_05, r.q_0_5, r.q_0_95] == [target[order][np.argmax(np.cumsum(w) >= q - 1e-9)] for q in (0.05, 0.5, 0.95)]


def test_second_writes_replace_their_own_part_only(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp_ntz'2024-01-05', 1), (timestamp_ntz'2024-02-05', 2) t(time, x)")
    tables.save_by_month(rows.filter("x = 1"), str(tmp_path / "m"))
    tables.save_by_month(rows.filter("x = 2"), str(tmp_path / "m"))
    assert values(spark.read.parquet(str(tmp_path / "m")), "month", "x") == [(1, 1), (2, 2)]


def test_names_with_dots(spark, tmp_path):
    df = spark.sql("select 1d lat, 2d lon, timestamp_ntz'2024-01-05' time, 6d `a.b`, 2d `c.d`")
    df.write.parquet(str(tmp_path / "x"))
    cube = tables.read_cube(spark, str(tmp_path / "x"))
    assert values(select.with_target(cube, "(a.b) / ((c.d) - 2)"), "target") == [(None,)]
    assert values(select.with_target(df, "-(a.b) / (c.d)"), "target") == [(-3.0,)]
    df.withColumn("a_b", F.lit(1.0)).write.parquet(str(tmp_path / "y"))
    with pytest.raises(ValueError):
        tables.read_cube(spark, str(tmp_path / "y"))


def test_sources_are_aligned(spark):
    a = spark.sql("select * from values (0d, 0d, 1, 1d, cast(null as double)), (0d, 1d, 1, null, 5d) t(lat, lon, time, x, y)")
    b = spark.sql("select * from values (0d, 0d, 1, 7d, 2d), (0d, 2d, 1, 8d, 3d) t(lat, lon, time, y, z)")
    cells = spark.sql("select 0d lat, 1d lon, 9d people")
    got = tables.combine_by_coords([a, b, cells])
    assert values(got, "lon", "x", "y", "z", "people") == [(0.0, 1.0, 7.0, 2.0, None), (1.0, None, 5.0, None, 9.0), (2.0, None, 8.0, 3.0, None)]


@pytest.mark.parametrize("edges", [[-80.0 + 20 * i for i in range(9)] + [90.0], [0.1 * i for i in range(-1800, 1801)], [0.0, 1.0, 1.5, 4.0, 9.0, 9.5, 20.0, 21.0, 22.0, 30.0, 31.0, 40.0]])
def test_bins_of_regular_and_other_axes(spark, edges):
    xs = [e + d for e in edges[:: max(1, len(edges) // 60)] for d in (-1e-9, 0.0, 1e-9)] + [edges[0], edges[-1], edges[-1] + 1]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fn.edge_index(F.col("x"), edges).alias("i")).collect()
    for r in got:
        assert r.i == (None if not edges[0] <= r.x <= edges[-1] else sum(r.x >= e for e in edges[1:-1])), r


def test_training_rows_are_spread_over_the_cores(spark):
    """A table of one partition is dealt to all cores with the same rows; a small or a very large one stays as it is."""
    df = spark.range(0, 50_000, 1, 1).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("target"))
    rows, _ = forest.prepare(df, ["a"])
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == min(3, spark.sparkContext.defaultParallelism) and max(sizes) - min(sizes) <= 1 + 50_000 // 100
    assert rows.agg(F.sum("a"), F.count_distinct("a")).first()[:] == (sum(range(50_000)), 50_000)
    for same in (forest.spread(df, 20_000), forest.spread(df, 50_000, most=1)):
        assert same is df
