import numpy as np
import pytest
from pyspark.sql import functions as F

from skymesh.operators import attribution, forest, growth, report, trees
from skymesh.plans import catalog


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 2)).astype(float)
    y = x[:, 0] * 3 + (x[:, 1] > 5) * 40 + rng.normal(size=600)
    df = spark.createDataFrame([(i, float(a), float(b), float(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, target double, part int").cache()
    edges = growth.bin_edges(df, ["a", "b"])
    return x, y, df, edges, growth.points(df, ["a", "b"], ["k"], F.col("part"), edges).cache()


def brute(x, y, depth):
    """(feature, threshold, mean) in the order of the levels' left-first walk, by trying each split."""
    best = None
    for j in range(x.shape[1]):
        for c in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= c
            gain = left.sum() * y[left].mean() ** 2 + (~left).sum() * y[~left].mean() ** 2 - len(y) * y.mean() ** 2
            if gain > 0 and (best is None or gain > best[0] + 1e-9):
                best = gain, j, c, left
    if not depth or best is None:
        return [(-1, None, y.mean())]
    _, j, c, left = best
    return [(j, c, y.mean()), *brute(x[left], y[left], depth - 1), *brute(x[~left], y[~left], depth - 1)]


def walk(nodes, i=0):
    by = {n[1]: n for n in nodes}
    _, _, value, _, f, cut, left, right = by[i]
    return [(f, cut, value)] + (walk(nodes, left) + walk(nodes, right) if f >= 0 else [])


def test_trees_of_all_folds_are_those_of_brute_force(small):
    """Each fold's tree, without the rows that it holds out; the third part is held out by none."""
    x, y, _, edges, points = small
    got = growth.forests(points, edges, 2, numTrees=1, maxDepth=3)
    for f in range(2):
        own = np.arange(600) % 3 != f
        for have, want in zip(walk(got[f]), brute(x[own], y[own], 3), strict=True):
            assert have[0] == want[0] and have[1] == want[1] and abs(have[2] - want[2]) < 1e-9


def test_drawn_rows_are_the_same_however_they_are_dealt(small):
    _, _, _, edges, points = small
    one, other = (growth.forests(p, edges, 3, numTrees=5, maxDepth=4, minInstancesPerNode=9) for p in (points, points.repartition(7)))
    for a, b in zip(one, other, strict=True):
        assert [n[4:] for n in a] == [n[4:] for n in b] and np.allclose([n[2:4] for n in a], [n[2:4] for n in b])
        assert min(n[3] for n in a) >= 9 and len({tuple(n[2] for n in a if n[0] == t) for t in range(5)}) == 5
    ids = np.arange(100_000)
    counts = np.stack([growth.drawn(ids, t, 0) for t in range(8)])
    assert np.allclose(counts.mean(1), 1, atol=0.02) and np.allclose(counts.var(1), 1, atol=0.03) and np.abs(np.corrcoef(counts) - np.eye(8)).max() < 0.02


def test_deep_trees_are_walked_as_small_ones(small):
    """Over 62 leaves: no bits for the leaves; each row's leaf is that of the node table."""
    x, y, df, edges, points = small
    own = growth.grown(points, edges, 1, 1, 9, None)[0][0]
    assert own.feature.count(-1) > 62
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    value = own.arrays()[5][growth._at(own.arrays(), bins)]
    got = growth.predicted(df, df.sparkSession.createDataFrame(own.nodes(0, edges), attribution.NODES), ["a", "b"], ["k"]).orderBy("k").collect()
    assert np.allclose([r.predict for r in got], value)


def test_boosted_trees_fit_the_gradients(small):
    x, y, df, edges, points = small
    nodes = growth.boosted(points, edges, 1, maxIter=4, maxDepth=2, stepSize=0.2)[0]
    rows = np.arange(600) % 3 != 0
    have = np.zeros(600)
    for k in range(4):
        target = 2 * (y - have) if k else y
        tree = brute(x[rows], target[rows], 2)

        def value(row, at=0):
            f, cut, v = tree[at]
            if f < 0:
                return v, at + 1
            left, after = value(row, at + 1)
            right, end = value(row, after)
            return (left if row[f] <= cut else right), end

        have = have + (0.2 if k else 1.0) * np.array([value(r)[0] for r in x])
    got = growth.predicted(df, df.sparkSession.createDataFrame(nodes, attribution.NODES), ["a", "b"], ["k"], total=True).orderBy("k").collect()
    assert np.allclose([r.predict for r in got], have)


def test_importances_add_up(spark, small):
    nodes = growth.forests(small[4], small[3], 1, numTrees=4, maxDepth=3)[0]
    got = growth.importance(nodes, spark, ["a", "b"]).toPandas()
    assert abs(got.importance.sum() - 1) < 1e-9 and (got["std"] > 0).all()


def test_large_tables_are_dealt_to_bounded_tasks(spark):
    df = spark.range(0, 50_000, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    own = forest.bounded(df, 50_000, most=3_000)
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) % cores == 0 and max(sizes) <= 3_000 + 300 and own.count() == 50_000
    assert forest.bounded(df, 20_000) is df


def test_quantiles_of_equal_targets_and_empty_leaves(spark):
    """One value for half of the samples, and a leaf that no sample reaches."""
    rng = np.random.default_rng(8)
    target = np.where(rng.random(300) < 0.5, 2.0, rng.normal(size=300).round(1))
    leaf = rng.integers(0, 3, (300, 2))
    reach = np.array([[0, 1], [2, 2], [1, 7], [7, 7]])
    samples = spark.createDataFrame([(leaf[i].tolist(), float(target[i])) for i in range(300)], "leaves array<int>, target double")
    rows = spark.createDataFrame([(k, reach[k].tolist()) for k in range(4)], "k int, leaves array<int>")
    order = np.argsort(target, kind="stable")
    for bins in (1, 4, 40):
        got = {r.k: [r.q_0_05, r.q_0_5, r.q_0_95] for r in forest.quantiles(samples, rows, ["k"], [0.05, 0.5, 0.95], bins=bins).collect()}
        assert set(got) == {0, 1, 2}
        for k, have in got.items():
            met = [leaf[:, t] == reach[k, t] for t in range(2) if (leaf[:, t] == reach[k, t]).any()]
            w = sum(m / m.sum() for m in met)[order] / len(met)
            assert have == [target[order][np.argmax(np.cumsum(w) >= q - 1e-9)] for q in (0.05, 0.5, 0.95)]


def test_waterfalls_of_rows_are_those_of_long_explanations(spark):
    names = ["b", "a", "c", "d"]
    rows = [(1, [1.0, -1.0, 0.5, 3.0], 2.0), (2, [0.0, 0.0, 0.0, -0.25], 7.0)]
    wide = spark.createDataFrame(rows, "k int, shap_values array<double>, base_value double")
    long = spark.createDataFrame([(k, f, x, b) for k, v, b in rows for f, x in zip(names, v, strict=True)], "k int, feature string, shap_value double, base_value double")
    for most in (2, 3, 4, 10):
        one, other = report.waterfall_rows(wide, names, ["k"], most), report.waterfall(long, ["k"], most).select("k", "rank", "feature", "shap_value", "base_value", "upto")
        assert one.dtypes == other.dtypes and sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_points_are_stored_in_blocks(spark, small, tmp_path):
    """A level moves a few large values, not a row for each row of the table, and row groups stay small; none is lost."""
    x, y, _, edges, points = small
    got = growth.stored(points, str(tmp_path / "points")).toPandas()
    assert len(got) < 60 and sum(len(v) for v in got["y"]) == 600 * 8
    bins = np.concatenate([np.frombuffer(c, np.uint8).reshape(2, -1) for c in got["codes"]], 1)
    have = sorted(zip(*bins.tolist(), np.concatenate([np.frombuffer(v) for v in got["y"]]).tolist(), strict=True))
    assert have == sorted(zip(*(np.searchsorted(e, x[:, j]).tolist() for j, e in enumerate(edges)), y.tolist(), strict=True))


def test_rows_of_all_folds_take_their_own_forest_in_one_pass(spark, small):
    """In parts of any size, mixed in a batch: what each fold gives alone; nothing is exchanged, whatever the number of folds."""
    _, _, df, edges, points = small
    nodes = growth.forests(points, edges, 3, numTrees=4, maxDepth=3)
    table = lambda rows: spark.createDataFrame(rows, attribution.NODES)
    forests = ("part", range(3))
    plain = lambda rows: [[r.k, r.predict, *r.contributions] for r in rows]
    alone = [r for f in range(3) for r in plain(attribution.interpret_rows(df.filter(F.col("part") == f), table(nodes[f]), ["a", "b"], ["k"]).collect())]
    for most in (1, 40, 1 << 20):
        got = attribution.interpret_rows(df, table(growth.in_one(nodes)), ["a", "b"], ["k", "part"], most, forests)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert np.allclose(sorted(plain(got.collect())), sorted(alone))
        shap = attribution.shapley_rows(df, table(growth.in_one(nodes)), ["a", "b"], ["k", "part"], most, forests)
        sums = {r.k: r.base_value + sum(r.shap_values) for r in shap.collect()}
        assert all(abs(sums[k] - p) < 1e-9 for k, p, *_ in alone)
    with pytest.raises(ValueError, match="equally many"):
        attribution.interpret_rows(df, table(nodes[0]), ["a", "b"], ["k", "part"], forests=forests)


def test_held_out_rows_are_evaluated_over_blocks(spark, small):
    """By bins as by features, row by row, for small trees and for trees of over 62 leaves; rows that no fold holds out aren't given."""
    _, _, df, edges, points = small
    for depth in (3, 9):
        nodes = growth.forests(points, edges, 2, numTrees=2, maxDepth=depth)
        assert max(sum(n[0] == 0 and n[4] < 0 for n in own) for own in nodes) > (62 if depth == 9 else 1)
        own = {"df": df.filter("part < 2"), "nodes": spark.createDataFrame(growth.in_one(nodes), attribution.NODES), "features": ["a", "b"], "forests": ("part", [0, 1])}
        for total in (False, True):
            got = growth.held_predicted(points, nodes, edges, total).collect()
            want = growth.predicted(keep=["part", "target"], total=total, **own).collect()
            assert len(got) == 400 and sorted(map(tuple, got)) == sorted(map(tuple, want))
        got = attribution.interpret_held(points, nodes, edges).collect()
        want = attribution.interpret_rows(keys=["part"], **own).collect()
        assert sorted((*r[:3], *r[3]) for r in got) == sorted((*r[:3], *r[3]) for r in want)


def test_points_are_sent_by_rows_and_named_once(spark, small, tmp_path):
    """While points are stored no limit in bytes is checked for each row; the session keeps its own.  Rows that have their identity give the
    same points as rows with keys."""
    _, _, df, edges, points = small
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with growth.by_rows(spark):
        assert spark.conf.get(key) == str(2**31 - 1)
    with growth.by_rows(spark, most=1):
        assert spark.conf.get(key) == before
    named = growth.points(df.select("a", "b", "target", "part", growth.identity(["k"])), ["a", "b"], None, F.col("part"), edges)
    assert growth.stored(named, f"{tmp_path}/p").count() and spark.conf.get(key) == before
    hashes = lambda p: sorted(i for b in p.collect() for i in np.frombuffer(b.ids, np.int64).tolist())
    assert hashes(named) == hashes(points) and len(hashes(named)) == 600


def test_scores_of_folds_read_no_features_again(spark):
    """Scores of all folds are computed over the stored blocks alone: the last step scans one folder, and no column of a feature or key."""
    got = catalog.fold_scores(spark, "/root/testdata/sf0.001", numTrees=2, maxDepth=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" in plan and not any(name in plan for name in [*catalog.FEATURES, *catalog.ROW_KEY])
    assert [r.fold for r in got.orderBy("fold").collect()] == list(catalog.YEARS)


@pytest.mark.parametrize("by_year", [False, True])
def test_training_rows_are_joined_once(spark, monkeypatch, by_year):
    """Counts and checks read what is stored; incomplete rows, NaN and infinities are left out as before."""
    seen, plain = spark.sparkContext.accumulator(0), catalog.ml_rows
    odd = F.when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 3, None).when(F.col("l_linenumber") == 4, float("inf")).otherwise(F.col("l_tax"))

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def rows(*args):
        own = plain(*args).withColumn("l_tax", odd)
        return own.mapInArrow(counted, own.schema)

    monkeypatch.setattr(catalog, "ml_rows", rows)
    path = "/root/testdata/sf0.001"
    got = catalog.stored_training(spark, path, by_year).drop("id").orderBy(*catalog.ROW_KEY).collect()
    own = plain(spark, path)
    assert seen.value == own.count()
    want = own.filter("l_linenumber not in (2, 3, 4)").select(*catalog.ROW_KEY, *catalog.FEATURES, "target", "year").orderBy(*catalog.ROW_KEY).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) < seen.value


def test_permutation_importance_over_blocks_by_hand(small):
    """Each fold's rows in the order of part and hash; a bijection gives each a place in the sorted column.  Any parts, any partitions, for
    equal hashes too."""
    x, y, df, edges, _ = small
    for keys in (["k"], ["twin"]):
        named = df.withColumn("twin", F.floor(F.col("k") / 6)).withColumn("l_one", F.lit(1.0))
        own = growth.points(named, ["a", "b", "l_one"], keys, F.col("part"), [*edges, np.zeros(0)])
        own.cache()
        nodes = growth.forests(own, [*edges, np.zeros(0)], 2, numTrees=3, maxDepth=3)
        got = {(r.number, r.feature): r for r in growth.permutation_importance(own, nodes, [*edges, np.zeros(0)], ["a", "b", "l_one"], repeats=4, seed=5).collect()}
        dealt = growth.points(named.repartition(7), ["a", "b", "l_one"], keys, F.col("part"), [*edges, np.zeros(0)])
        again = growth.permutation_importance(dealt, nodes, [*edges, np.zeros(0)], ["a", "b", "l_one"], repeats=4, seed=5).collect()
        assert len(got) == len(again) == 6 and all(np.allclose(tuple(got[r.number, r.feature])[2:], tuple(r)[2:]) for r in again)
        if keys == ["twin"]:
            continue
        ids = np.array([r.id for r in named.select("k", growth.identity(keys)).orderBy("k").collect()])
        for f in range(2):
            rows = np.flatnonzero(np.arange(600) % 3 == f)
            shapes = [(s, t.value) for t, s in growth.by_bins(nodes[f], edges)]
            bins = np.stack([*(np.searchsorted(e, x[rows, j]) for j, e in enumerate(edges)), np.zeros(200, int)])
            predict = lambda b, shapes=shapes: np.mean([v[growth._at(s, b)] for s, v in shapes], 0)
            at = np.argsort(np.argsort(ids[rows]))
            r2 = lambda b, rows=rows, predict=predict: 1 - ((y[rows] - predict(b)) ** 2).sum() / ((y[rows] - y[rows].mean()) ** 2).sum()
            for j, name in enumerate(["a", "b", "l_one"]):
                drops = []
                for key in np.random.default_rng(5).integers(1, 2**31, 4):
                    moved = bins.copy()
                    moved[j] = np.sort(bins[j])[trees.permuted(at, 200, int(key))]
                    assert sorted(moved[j]) == sorted(bins[j])
                    drops.append(r2(bins) - r2(moved))
                have = got[f, name]
                assert have.n == 200 and np.allclose([have.importance, have["std"]], [np.mean(drops), np.std(drops)])
        small_parts = growth.permutation_importance(own, nodes, [*edges, np.zeros(0)], ["a", "b", "l_one"], repeats=40, each=50).collect()
        one_part = growth.permutation_importance(own, nodes, [*edges, np.zeros(0)], ["a", "b", "l_one"], repeats=40).collect()
        near = {(r.number, r.feature): r for r in one_part}
        assert len(small_parts) == 6 and all(abs(r.importance - near[r.number, r.feature].importance) < 0.05 for r in small_parts)


def test_rows_are_dealt_once_as_blocks(small):
    """What is exchanged is the bytes of each row of a fold, once, whatever the repeats; none is lost."""
    *_, points = small
    own = growth.dealt(points, lambda y, ids, fold: np.where(fold < 2, growth._part(ids, 5), -1), 5, 2, most=90).toPandas()
    ids = np.concatenate([np.frombuffer(v, np.int64) for v in own["ids"]])
    every, folds = (np.concatenate([np.frombuffer(b[c], t) for b in points.collect()]) for c, t in (("ids", np.int64), ("folds", np.int32)))
    assert sorted(ids) == sorted(every[folds < 2]) and growth.row_count(points) == 600
    assert sum(len(v) for c in ("codes", "y", "ids", "folds") for v in own[c]) == 400 * (2 + 8 + 8 + 4)
    assert all((growth._part(np.frombuffer(v, np.int64), 5) == p).all() for p, v in zip(own["part"], own["ids"], strict=True))


def test_permutations_store_no_rows_by_fold(spark, monkeypatch):
    """Rows are stored once as they are and once in blocks; no year's rows are read, joined or written again."""
    names, plain = [], catalog.shared
    monkeypatch.setattr(catalog, "shared", lambda spark, name: names.append(name) or plain(spark, name))
    got = catalog.perm_importance(spark, "/root/testdata/sf0.001").collect()
    assert names == ["training", "points"] and len(got) == 35 and {r.fold for r in got} == set(catalog.YEARS)


@pytest.mark.parametrize("heavy", [False, True])
def test_quantiles_over_blocks_are_those_of_samples_by_leaves(spark, small, tmp_path, heavy):
    """For any parts, with a value that half of the rows have, for trees of over 62 leaves: what each fold's samples give alone."""
    _, _, df, _, _ = small
    own = df.withColumn("target", F.when(F.col("k") % 2 == 0, 50.0).otherwise(F.round("target", 1))) if heavy else df
    edges = growth.bin_edges(own, ["a", "b"])
    points = growth.points(own, ["a", "b"], ["k"], F.col("part"), edges).repartition(5).cache()
    at = [0.0, 0.05, 0.5, 0.95, 1.0]
    names = ["q_0", "q_0_05", "q_0_5", "q_0_95", "q_1"]
    store = lambda d, name: growth.stored(d, f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    for depth in (2, 9):
        nodes = growth.forests(points, edges, 2, numTrees=2, maxDepth=depth)
        leaves = lambda d, keep, n: attribution.leaves_by_rules(d, spark.createDataFrame(n, attribution.NODES), ["a", "b"], keep)
        want = []
        for f in range(2):
            rows, others = own.filter(F.col("part") == f), own.filter(F.col("part") != f)
            want += forest.quantiles(leaves(others, ["target"], nodes[f]), leaves(rows, ["k"], nodes[f]), ["k"], at).select("k", *names).collect()
        for params in ({"each": 7}, {"each": 60}, {"each": 10_000}, {"each": 7, "numbers": 1}, {"each": 30, "few": 0}):
            found = growth.quantiles(points, nodes, edges, at, own, store, **params)
            got = growth.kinds_of(own, nodes, edges, ["a", "b"], ["k", "part"], ("part", [0, 1])).join(found, "kind").select("k", *names).collect()
            assert len(got) == 400 and sorted(map(tuple, got)) == sorted(map(tuple, want))
        held = growth.held_kinds(points, nodes, edges).join(found, "kind").select("number", "target", *names).collect()
        both = own.select("k", "part", "target").join(spark.createDataFrame(want), "k").select("part", "target", *names).collect()
        assert sorted(map(tuple, held)) == sorted(map(tuple, both))


def test_a_value_of_many_samples_is_in_no_part(spark, small, tmp_path):
    """Samples that share a value are counted where they are; the others are exchanged once for all folds, and each part stays small."""
    _, _, df, _, _ = small
    own = df.withColumn("target", F.when(F.col("k") % 2 == 0, 50.0).otherwise(F.col("target")))
    edges = growth.bin_edges(own, ["a", "b"])
    points = growth.points(own, ["a", "b"], ["k"], F.col("part"), edges).cache()
    kept = {}

    def store(d, name):
        kept[name] = growth.stored(d, f"{tmp_path}/{name}")
        return kept[name]

    growth.quantiles(points, growth.forests(points, edges, 3, numTrees=2, maxDepth=3), edges, [0.5], own, store, each=30)
    parts = [np.frombuffer(r.y) for r in kept["samples"].collect()]
    assert 200 < sum(map(len, parts)) <= 300 and max(map(len, parts)) <= 60
    assert all((np.diff(y) >= 0).all() and 50.0 not in y for y in parts)
    assert max(y.max() for y in parts) == own.agg(F.max("target")).first()[0]


@pytest.mark.parametrize("name", ["rf_quantiles", "rf_interval_coverage"])
def test_quantiles_of_all_folds_are_found_in_one_pass(spark, monkeypatch, name):
    """Samples of all folds are dealt once, not a year at a time."""
    names, plain = [], catalog.shared
    monkeypatch.setattr(catalog, "shared", lambda spark, n: names.append(n) or plain(spark, n))
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() == (7 if name == "rf_interval_coverage" else catalog.ml_rows(spark, "/root/testdata/sf0.001").count())
    assert names == ["training", "points", "samples", "kinds", "wanted", "quantiles"]
