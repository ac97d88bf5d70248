"""Forests as flat arrays that tasks evaluate: leaves reached, contributions, Shapley values, caps, permutations.

A tree's nodes are numbered level by level, so children follow their parents and a step over a level is a few array
operations for all its nodes and a block of rows.  Rows stay where they are: a forest goes to them in parts of at most
``NODES`` nodes (or one larger tree), a map for each part, and each map adds its part to the sums that rows carry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["node", "feature", "threshold", "left", "right", "value", "cover"]
#: nodes of a part of a forest (about 40 bytes each)
NODES = 1 << 20
#: numbers in the largest array of a step
CELLS = 1 << 21
#: features up to which all patterns of held and missing features are tabled for each leaf
PATTERNS = 6


@dataclass
class Tree:
    """Nodes by level: ``left`` and ``right`` are 0 for leaves; ``leaf`` numbers the leaves, left first."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    leaf: np.ndarray
    levels: list[tuple[int, int]]

    @classmethod
    def of(cls, node, feature, threshold, left, right, value, cover) -> Tree:
        at = {n: i for i, n in enumerate(node.tolist())}
        inner = feature >= 0
        child = [np.array([at[c] if i else -1 for c, i in zip(x.tolist(), inner.tolist(), strict=True)], np.int64) for x in (left, right)]
        below = np.ones(len(node), bool)
        for c in child:
            below[c[inner]] = False
        level, order, levels, n = np.flatnonzero(below), [], [], 0
        while len(level):
            order.append(level)
            levels.append((n, n + len(level)))
            n += len(level)
            own = level[inner[level]]
            level = np.column_stack([c[own] for c in child]).ravel()
        order = np.concatenate(order)
        new = np.empty(len(node), np.int64)
        new[order] = np.arange(len(order))
        sides = [np.where(inner[order], new[c[order]], 0) for c in child]
        own = cls(feature[order].astype(np.int64), threshold[order], *sides, value[order], cover[order], np.full(len(order), -1, np.int64), levels)
        # how many leaves stand below each node, bottom up; then each leaf's number, top down
        inner = own.feature >= 0
        many = (~inner).astype(np.int64)
        first = np.zeros(len(order), np.int64)
        for a, b in reversed(levels):
            i = np.arange(a, b)[inner[a:b]]
            many[i] = many[own.left[i]] + many[own.right[i]]
        for a, b in levels:
            i = np.arange(a, b)[inner[a:b]]
            first[own.left[i]], first[own.right[i]] = first[i], first[i] + many[own.left[i]]
        own.leaf[~inner] = first[~inner]
        return own

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each row; a missing value goes right."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.levels) - 1):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            if not len(rows):
                break
            now = at[rows]
            at[rows] = np.where(x[rows, f] <= self.threshold[now], self.left[now], self.right[now])
        return at

    @cached_property
    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """The parent of each node but the root, which is its own, and the feature that splits it (root: -1)."""
        parent, split = np.zeros(len(self.feature), np.int64), np.full(len(self.feature), -1, np.int64)
        inner = np.flatnonzero(self.feature >= 0)
        for child in (self.left, self.right):
            parent[child[inner]], split[child[inner]] = inner, self.feature[inner]
        return parent, split

    def changes(self, features: int) -> np.ndarray:
        """Of each leaf, in order, the changes of value on its way from the root, by the feature that splits."""
        out = np.zeros((len(self.feature), features))
        parent, split = self.parents
        for a, b in self.levels[1:]:
            i = np.arange(a, b)
            out[i] = out[parent[i]]
            out[i, split[i]] += self.value[i] - self.value[parent[i]]
        return out[self.leaves]

    @cached_property
    def leaves(self) -> np.ndarray:
        """The leaf nodes, left first."""
        own = np.flatnonzero(self.feature < 0)
        return own[np.argsort(self.leaf[own])]

    @cached_property
    def paths(self) -> tuple[np.ndarray, ...]:
        """(parent, split, up, low, high, share, last): of each node's edge from its parent, the last edge above it that splits by the
        same feature (0: none), the interval (low, high] of the feature, the share of cover that goes that way, and
        the last edge of each feature on the way."""
        parent, split = self.parents
        n = len(self.feature)
        names = np.unique(split[1:]) if n > 1 else np.zeros(0, np.int64)
        column = np.searchsorted(names, split)
        last = np.zeros((n, len(names)), np.int64)  # of each feature, the last edge on the way
        up = np.zeros(n, np.int64)
        low, high, share = np.full(n, -np.inf), np.full(n, np.inf), np.ones(n)
        for a, b in self.levels[1:]:
            i = np.arange(a, b)
            p = parent[i]
            last[i] = last[p]
            up[i] = last[i, column[i]]
            is_left = self.left[p] == i
            low[i] = np.where(is_left, low[up[i]], np.maximum(low[up[i]], self.threshold[p]))
            high[i] = np.where(is_left, np.minimum(high[up[i]], self.threshold[p]), high[up[i]])
            share[i] = share[up[i]] * np.maximum(self.cover[i] / self.cover[p], 1e-15)  # a factor is never 0
            last[i, column[i]] = i
        return parent, split, up, low, high, share, last

    def expected(self) -> float:
        """The mean of the leaves by cover."""
        whole = np.ones(len(self.feature))
        parent, _ = self.parents
        for a, b in self.levels[1:]:
            i = np.arange(a, b)
            whole[i] = whole[parent[i]] * self.cover[i] / self.cover[parent[i]]
        return float((whole * self.value)[self.feature < 0].sum())

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the rows of ``x``.

        A leaf's share of feature i is the integral over t in (0, 1) of the product, over the other features of its path, of
        t (if the row holds) + (1 - t) share, times (holds - share of i).  That is a polynomial in t whose degree is less than
        the number of these features, so a few Gauss points give it exactly."""
        x = np.where(np.isnan(x), np.inf, x)  # goes right
        out = np.zeros(x.shape)
        if len(self.feature) == 1:
            return out
        edges, last = self.paths[:-1], self.paths[-1][self.leaves]
        most = int((last > 0).sum(1).max())
        points, weights = np.polynomial.legendre.leggauss(-(-most // 2))
        gauss = (points + 1) / 2, weights / 2
        m = last.shape[1]
        if m <= PATTERNS and len(last) * m << m <= CELLS:
            self._by_pattern(x, out, last, *gauss)
        else:
            self._by_level(x, out, edges, *gauss)
        return out

    def _by_pattern(self, x, out, last, points, weights) -> None:
        """Whether a row holds for each feature of a leaf makes a pattern; what each pattern gives is tabled."""
        _, split, _, low, high, share, _ = self.paths
        names = np.unique(split[1:])
        n, m = last.shape
        z = np.where(last > 0, share[last], 1.0)
        held = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)  # pattern x feature
        there = last > 0
        table = np.zeros((n, 1 << m, m))
        for t, w in zip(points, weights, strict=True):
            factor = np.where(there[:, None, :], t * held + (1 - t) * z[:, None, :], 1.0)
            table += w * factor.prod(2, keepdims=True) / factor
        table *= np.where(there[:, None, :], held - z[:, None, :], 0.0) * self.value[self.leaves][:, None, None]
        flat = table.reshape(n << m, m)
        # of each feature and each interval between its bounds, the bit of the leaves whose interval holds it
        lows, highs = np.where(there, low[last], -np.inf), np.where(there, high[last], np.inf)
        bits, bounds = [], []
        for j in range(m):
            edge = np.unique(np.concatenate([lows[:, j], highs[:, j]]))
            edge = edge[np.isfinite(edge)]
            upper = np.append(edge, np.inf)[:, None]
            bits.append(((upper > lows[:, j]) & (upper <= highs[:, j])).astype(np.int32) << j)
            bounds.append(edge)
        base, ones = np.arange(n, dtype=np.int32) << m, np.ones((1, n))
        step = max(1, CELLS // (8 * n * m))  # what is gathered stays in a cache
        for a in range(0, len(x), step):
            part = x[a : a + step]
            pattern = np.tile(base, (len(part), 1))
            for j, f in enumerate(names.tolist()):
                pattern += bits[j][np.searchsorted(bounds[j], part[:, f], "left")]
            out[a : a + step, names] += (ones @ flat.take(pattern, 0))[:, 0]

    def _by_level(self, x, out, edges, points, weights) -> None:
        """Products of the factors go down the levels, sums of the leaves come up; an edge's feature gets the sum below it, less
        what the last edge of that feature above it already has."""
        parent, split, up, low, high, share = edges
        n = len(self.feature)
        order = np.argsort(split[1:], kind="stable") + 1
        names, starts = np.unique(split[order], return_index=True)
        leaf, inner = self.feature < 0, np.flatnonzero(self.feature >= 0)
        step = max(1, CELLS // n)
        for a in range(0, len(x), step):
            own = x[a : a + step].T[np.maximum(split, 0)]
            holds = (own > low[:, None]) & (own <= high[:, None])
            for t, w in zip(points, weights, strict=True):
                factor = (1 - t) * share[:, None] + t * holds
                factor[0] = 1.0
                gain = (holds - share[:, None]) / factor
                gain[0] = 0.0
                product = factor / factor[up]
                for c, d in self.levels[1:]:
                    product[c:d] *= product[parent[c:d]]
                total = np.where(leaf[:, None], product * self.value[:, None], 0.0)
                for c, d in reversed(self.levels):
                    i = inner[(inner >= c) & (inner < d)]
                    total[i] = total[self.left[i]] + total[self.right[i]]
                total *= gain - gain[up]
                out[a : a + step, names] += w * np.add.reduceat(total[order], starts, 0).T


def parts(nodes: DataFrame, most: int = NODES) -> Iterator[list[Tree]]:
    """The trees of a node table, as many at a time as have ``most`` nodes."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()  # a row for each tree
    lots: list[list[int]] = []
    held = most + 1
    for tree, n in sizes:
        if held + n > most:
            lots.append([])
            held = 0
        lots[-1].append(tree)
        held += n
    for lot in lots:
        own = nodes.filter(F.col("tree").between(lot[0], lot[-1])).select("tree", *COLUMNS).toPandas()
        yield [Tree.of(*(g[c].to_numpy(float if c in ("threshold", "value", "cover") else np.int64) for c in COLUMNS)) for _, g in own.groupby("tree", sort=True)]


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Rows x features; null is NaN."""
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]) if features else np.zeros((batch.num_rows, 0))


#: a column, and of each forest in order the value that its rows have there
Forests = tuple[str, Sequence] | None


def _given(b: pa.RecordBatch, own: dict, by: str | None, x: np.ndarray, width: int, give) -> np.ndarray:
    """What each row's forest gives; ``own`` has the trees by the value of the column ``by``, or all under None."""
    if by is None:
        return give(own[None], x)
    out, value = np.zeros((len(x), width)), b.column(by).to_numpy(zero_copy_only=False)
    for v, forest in own.items():
        rows = np.flatnonzero(value == v)
        if len(rows) == len(x):
            return give(forest, x)
        if len(rows):
            out[rows] = give(forest, x[rows])
    return out


def _added(batches, own: dict, by: str | None, features: list[str], width: int, give) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sums = _given(b, own, by, matrix(b, features), width, give)
        names = [n for n in b.schema.names if n != "sums"]
        if len(names) < b.num_columns:
            sums = sums + b.column("sums").flatten().to_numpy().reshape(b.num_rows, width)
        ends = pa.array(np.arange(0, sums.size + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], [*names, "sums"])


def summed(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str], width: int, give, most: int = NODES, forests: Forests = None) -> tuple[DataFrame, int]:
    """``keep`` and the features of each row with ``sums``: what ``give(trees, rows)`` gives, ``width`` numbers a row, summed over the
    forest's parts; and the number of trees.  With ``forests`` the table has several forests of equally many trees, one after the other, and
    each row takes the trees of its own, by its value of a column (in ``keep``)."""
    names = list(dict.fromkeys([*keep, *features]))
    out = df.select(*(F.col(f"`{c}`").cast("double").alias(c) if c in features else F.col(f"`{c}`") for c in names))
    schema = out.select("*", F.array_repeat(F.lit(0.0), width).alias("sums")).schema
    by, values = forests or (None, [None])
    lots, count = [], 0
    for lot in parts(nodes, most):
        lots.append((count, lot))
        count += len(lot)
    each = max(1, count // len(values))
    if count != each * len(values):
        raise ValueError(f"{count} trees are no {len(values)} forests of equally many")
    for first, lot in lots:
        own: dict = {}
        for k, tree in enumerate(lot, first):
            own.setdefault(values[k // each], []).append(tree)
        out = out.mapInArrow(partial(_added, own=own, by=by, features=list(features), width=width, give=give), schema)
    return out, each


# -- leaf caps ------------------------------------------------------------------------------------
def best_first(tree: Tree, leaves: int) -> np.ndarray:
    """Which inner nodes stay open when a tree grows from its root, always at the leaf whose split gains most, to ``leaves``
    leaves.  A split's gain is the cover of its children times the square of their change of value; ties go to the node
    nearer to the root, then further left."""
    opened = np.zeros(len(tree.feature), bool)
    inner = np.flatnonzero(tree.feature >= 0)
    gain = np.zeros(len(tree.feature))
    for child in (tree.left, tree.right):
        gain[inner] += tree.cover[child[inner]] * (tree.value[child[inner]] - tree.value[inner]) ** 2
    heap = [(-gain[0], 0)] if tree.feature[0] >= 0 else []
    for _ in range(leaves - 1):
        if not heap:
            break
        _, i = heappop(heap)
        opened[i] = True
        for c in (tree.left[i], tree.right[i]):
            if tree.feature[c] >= 0:
                heappush(heap, (-gain[c], int(c)))
    return opened


def _capped(pdf: pd.DataFrame, leaves: int) -> pd.DataFrame:
    own = Tree.of(*(pdf[c].to_numpy(float if c in ("threshold", "value", "cover") else np.int64) for c in COLUMNS))
    opened = best_first(own, leaves)
    stays = opened.copy()
    stays[0] = True
    for child in (own.left, own.right):
        stays[child[opened]] = True
    shown = lambda x, none: np.where(opened, x, none)
    out = {"tree": int(pdf["tree"].iloc[0]), "node": np.arange(len(opened)), "value": own.value, "cover": own.cover, "feature": shown(own.feature, -1), "threshold": shown(own.threshold, np.nan), "left": shown(own.left, -1), "right": shown(own.right, -1)}
    out = pd.DataFrame(out)[stays]
    return out.assign(threshold=out["threshold"].astype(object).where(opened[stays], None))


def leaf_capped(nodes: DataFrame, leaves: int) -> DataFrame:
    """The node table of the forest whose trees have at most ``leaves`` leaves, grown best first; nodes get new numbers.

    A split doesn't depend on the order in which nodes are opened, so this is the tree that growing under the cap would
    have given.  A tree is one group, whose size the training parameters bound."""
    if leaves < 1:
        raise ValueError("a tree has a leaf at least")

    def capped(pdf: pd.DataFrame) -> pd.DataFrame:
        return _capped(pdf, leaves)

    return nodes.select("tree", *COLUMNS).groupBy("tree").applyInPandas(capped, "tree int, node int, value double, cover double, feature int, threshold double, left int, right int")


# -- permutation importance -----------------------------------------------------------------------
def mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of the numbers under ``n``, one for each key: a Feistel network over as many bits as ``n`` needs, walked on
    until the number is under ``n``."""
    half = np.uint64(max(1, -(-(max(1, n - 1)).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out = np.asarray(at, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in range(6):
            left, right = right, left ^ (mixed(right, key * 64 + k + 1) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _moved(batches, n: int, keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Each row once for each key, at its place of that permutation."""
    for b in batches:
        at = b.column("at").to_numpy()
        for rep, key in enumerate(keys):
            new = {"at": pa.array(permuted(at, n, key)), "rep": pa.array(np.full(len(at), rep, np.int32))}
            yield pa.RecordBatch.from_arrays([new["at"], new["rep"], *(b.column(c) for c in b.schema.names if c != "at")], ["at", "rep", *(c for c in b.schema.names if c != "at")])


def _lost(batches, forest: list[Tree], features: list[str]) -> Iterator[pa.RecordBatch]:
    """Squared errors of rows as they are (feature -1) and with one feature from the other row, summed by repeat and feature.
    Only trees that split by the feature are walked again."""
    m = len(features)
    uses = [set(t.feature[t.feature >= 0].tolist()) for t in forest]
    for b in batches:
        if not b.num_rows:
            continue
        x, other = matrix(b, features), matrix(b, [f"o_{f}" for f in features])
        y, rep = b.column("target").to_numpy(), b.column("rep").to_numpy()
        plain = np.stack([t.value[t.reached(x)] for t in forest])
        total = plain.sum(0)
        errors = [(y - total / len(forest)) ** 2]
        for j in range(m):
            now, kept = total, x[:, j].copy()
            x[:, j] = other[:, j]
            for t, u, v in zip(forest, uses, plain, strict=True):
                if j in u:
                    now = now + t.value[t.reached(x)] - v
            x[:, j] = kept
            errors.append((y - now / len(forest)) ** 2)
        reps = np.unique(rep)
        sums = np.array([[e[rep == r].sum() for e in errors] for r in reps])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps, m + 1)), pa.array(np.tile(np.arange(-1, m, dtype=np.int32), len(reps))), pa.array(sums.ravel())], ["rep", "feature", "error"])


def numbered(df: DataFrame, keys: Sequence[str], seed: int, columns: Sequence) -> tuple[DataFrame, int]:
    """``columns`` with ``at``: a dense number from 0 in the order of the keys' hash, and the number of rows.

    Numbers are counted in bins of the hash, so no window takes all rows; there are at most 10,000 bins, so their offsets
    stay small."""
    n = df.count()
    binned = df.withColumn("__h", F.xxhash64(*keys, F.lit(seed))).withColumn("__b", F.pmod("__h", F.lit(min(10_000, max(1, n // 20_000)))))
    sizes = binned.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__s"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *keys)) - 1 + F.col("__s")
    return binned.join(F.broadcast(before), "__b").select(at.alias("at"), *columns), n


def permutation_importance(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], repeats: int = 5, seed: int = 1, most: int = NODES) -> DataFrame:
    """(feature, importance, std) of a forest: mean and deviation of the drop of R2 when a feature's values are permuted.

    Rows are numbered once in the order of their keys' hash; each repeat pairs them by a bijection of its own.  One join for
    all repeats and features; the errors are summed where rows are.  The forest goes to tasks as one part."""
    own = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    base, n = numbered(df.select(*keys, "target", *(c for c in features if c not in keys)), keys, seed, [F.col("target").cast("double").alias("target"), *own])
    forest = [t for lot in parts(nodes, most) for t in lot]
    rng = np.random.default_rng(seed)
    moved = base.select("at", *(F.col(f).alias(f"o_{f}") for f in features))
    types = "at bigint, rep int, " + ", ".join(f"`o_{f}` double" for f in features)
    moved = moved.mapInArrow(partial(_moved, n=n, keys=[int(k) for k in rng.integers(1, 2**31, repeats)]), types)
    errors = base.join(moved, "at").mapInArrow(partial(_lost, forest=forest, features=list(features)), "rep int, feature int, error double")
    spread = base.agg((F.var_pop("target") * F.count(F.lit(1))).alias("spread"))  # one row
    total = errors.groupBy("rep", "feature").agg(F.sum("error").alias("error"))
    plain = total.filter("feature = -1").select("rep", F.col("error").alias("plain"))
    drop = total.filter("feature >= 0").join(plain, "rep").crossJoin(F.broadcast(spread)).select("feature", F.try_divide(F.col("error") - F.col("plain"), "spread").alias("drop"))
    name = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("feature") + 1)
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std")).select(name.alias("feature"), "importance", "std")
