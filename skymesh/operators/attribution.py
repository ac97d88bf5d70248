"""Attribution of forest predictions: path differences and exact tree SHAP.

A forest is a node table (tree, node, value, cover, feature, threshold, left, right), with feature -1 for
leaves.  The table of a Spark model is read from what its writer saves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymesh.operators import growth, trees

NODES = "tree int, node int, value double, cover double, feature int, threshold double, left int, right int"


def node_table(model, path: str, spark: SparkSession | None = None) -> DataFrame:
    """The nodes of a fitted forest, saved to ``path`` and read as a table."""
    spark = spark or SparkSession.getActiveSession()  # a thread of its own has no active session
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"),
        n["id"].cast("int").alias("node"),
        n["prediction"].alias("value"),
        n["rawCount"].cast("double").alias("cover"),
        F.when(n["leftChild"] < 0, -1).otherwise(n["split"]["featureIndex"]).cast("int").alias("feature"),
        F.when(n["leftChild"] >= 0, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        n["leftChild"].cast("int").alias("left"),
        n["rightChild"].cast("int").alias("right"),
    )


LEAVES = "tree int, leaf int, bias double, value double, contributions array<double>"


def _leaves_of_tree(pdf: pd.DataFrame, features: int) -> pd.DataFrame:
    """The leaves of one tree, left first: the parts of their path's changes of value by the parent's feature."""
    own = trees.Tree.of(*(pdf[c].to_numpy(float if c in ("threshold", "value", "cover") else np.int64) for c in trees.COLUMNS))
    return pd.DataFrame({"tree": int(pdf["tree"].iloc[0]), "leaf": own.leaf[own.leaves], "bias": own.value[0], "value": own.value[own.leaves], "contributions": list(own.changes(features))})


def leaf_paths(nodes: DataFrame, features: int) -> DataFrame:
    """One row for each leaf: its ordinal in the tree (left first), the tree's bias, its value, and of each feature
    the change of value along the path.  A tree is one group, whose size the training parameters bound."""

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        return _leaves_of_tree(pdf, features)

    return nodes.groupBy("tree").applyInPandas(leaves, LEAVES)


def interpret(reached: DataFrame, paths: DataFrame, keys: Sequence[str], features: int) -> DataFrame:
    """Of rows that reach leaves (keys, tree, leaf): (keys, predict, bias, contributions), an array with 0 for features
    that no path uses; averages over the trees.  One join with the leaves and one aggregation, for leaves that come as a
    table; rows whose features are known take ``interpret_rows``."""
    flat = paths.select("tree", "leaf", "bias", "value", *(F.col("contributions")[i].alias(f"d{i}") for i in range(features)))
    met = reached.join(flat, ["tree", "leaf"]).groupBy(*keys).agg(F.avg("value").alias("predict"), F.avg("bias").alias("bias"), *(F.avg(f"d{i}").alias(f"d{i}") for i in range(features)))
    return met.select(*keys, "predict", "bias", F.array(*(f"d{i}" for i in range(features))).alias("contributions"))


def _parts(tree: trees.Tree, features: int) -> np.ndarray:
    """Of each leaf, in order: its value, the root's, and the changes of value on the way by feature."""
    return np.column_stack([tree.value[tree.leaves], np.full(len(tree.leaves), tree.value[0]), tree.changes(features)])


def _contributions(forest: list[trees.Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), x.shape[1] + 2))
    for t in forest:
        out += _parts(t, x.shape[1])[t.leaf[t.reached(x)]]
    return out


def _interpreted(sums: DataFrame, keys: Sequence[str], features: int, count: int) -> DataFrame:
    mean = F.transform("sums", lambda v: v / count)
    return sums.select(*(F.col(f"`{k}`") for k in keys), mean[0].alias("predict"), mean[1].alias("bias"), F.slice(mean, 3, max(1, features)).alias("contributions"))


def interpret_held(points: DataFrame, forests: Sequence[Sequence[tuple]], edges: Sequence[np.ndarray]) -> DataFrame:
    """(number, predict, bias, contributions) of the rows of ``growth.points`` that each fold holds out, by the fold's forest (its node
    rows), as ``interpret_rows``: for what needs no keys, a block of rows costs one value where each row has one for each feature."""
    own = growth.held_out(points, forests, edges, len(edges) + 2, partial(_parts, features=len(edges)))
    return _interpreted(own, ["number"], len(edges), len({n[0] for n in forests[0]}))


def interpret_rows(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], most: int = trees.NODES, forests: trees.Forests = None) -> DataFrame:
    """(keys, predict, bias, contributions) of rows with their features, as ``interpret`` gives.  Each row's leaves index an
    array of the leaves' parts inside one map for each part of the forest: nothing is joined or exchanged.  ``forests`` as in
    ``trees.summed``."""
    sums, n = trees.summed(df, nodes, features, keys, len(features) + 2, _contributions, most, forests)
    return _interpreted(sums, keys, len(features), n)


def long_contributions(interpreted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, predict, bias, feature, contribution): a row for each feature."""
    return interpreted.select(*keys, "predict", "bias", F.posexplode("contributions").alias("feature", "contribution"))


def leaves_by_rules(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``leaves``, each row's leaf in each tree of a forest given as a node table, by one nested condition for each tree
    (for small forests; a fitted model gives its leaves itself).  A missing value goes right."""

    def leaf_of(tree: dict, node: int, first: int):
        r = tree[node]
        if r.feature < 0:
            return F.lit(first), first + 1
        left, n = leaf_of(tree, r.left, first)
        right, n = leaf_of(tree, r.right, n)
        return F.when(F.col(features[r.feature]) <= r.threshold, left).otherwise(right), n

    return df.select(*keep, F.array(*(leaf_of(t, _root(t), 0)[0] for _, t in sorted(_walk(nodes).items()))).alias("leaves"))


def reach_by_rules(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, tree, leaf) of rows in a small forest given as a node table, by ``leaves_by_rules``."""
    names = F.array(*(F.lit(k) for k in sorted(_walk(nodes))))
    own = leaves_by_rules(df, nodes, features, keys)
    return own.select(*keys, F.explode(F.arrays_zip(names.alias("tree"), "leaves")).alias("at")).select(*keys, "at.tree", F.col("at.leaves").alias("leaf"))


def _walk(nodes: DataFrame) -> dict[int, dict]:
    """The trees by their nodes, of small forests that become conditions."""
    trees_: dict[int, dict] = {}
    for r in nodes.collect():
        trees_.setdefault(r.tree, {})[r.node] = r
    return trees_


def _root(tree: dict) -> int:
    return (set(tree) - {c for r in tree.values() for c in (r.left, r.right)}).pop()


def _shapley(forest: list[trees.Tree], x: np.ndarray) -> np.ndarray:
    return np.column_stack([sum(t.shapley(x) for t in forest), np.full(len(x), sum(t.expected() for t in forest))])


def shapley_rows(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str], most: int = trees.NODES, forests: trees.Forests = None) -> DataFrame:
    """``keep``, ``shap_values`` (an array in the order of the features) and ``base_value``, a row for each row, as ``tree_shap``."""
    sums, n = trees.summed(df, nodes, features, keep, len(features) + 1, _shapley, most, forests)
    mean = F.transform("sums", lambda v: v / n)
    return sums.select(*(F.col(f"`{k}`") for k in keep), F.slice(mean, 1, max(1, len(features))).alias("shap_values"), mean[len(features)].alias("base_value"))


def tree_shap(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], most: int = trees.NODES) -> DataFrame:
    """The explanation (keys, feature, shap_value, feature_value, base_value) by exact tree SHAP, path-dependent.  The forest
    goes to the tasks as arrays, in parts of at most ``most`` nodes; rows stay where they are."""
    sums, n = trees.summed(df, nodes, features, keys, len(features) + 1, _shapley, most)
    each = F.array(*(F.struct(F.lit(f).alias("feature"), (F.col("sums")[i] / n).alias("shap_value"), F.col(f"`{f}`").alias("feature_value")) for i, f in enumerate(features)))
    return sums.select(*(F.col(f"`{k}`") for k in keys), (F.col("sums")[len(features)] / n).alias("base_value"), F.explode(each).alias("x")).select(*(F.col(f"`{k}`") for k in keys), "x.*", "base_value")
