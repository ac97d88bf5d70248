"""The prefix trie against a plain trie in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skymesh.llm import queries, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = {}
    for p, m in nodes.items():
        stop = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out[min(m), len(p)] = (min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(stop.encode()).hexdigest())
    return out


def shape(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_query_by_a_plain_trie(spark):
    got = queries.QUERIES["op13_euler_prefix_trie"](spark, SF)
    assert [t for c, t in got.dtypes if c != "ends_sha256"] == ["bigint"] * 7
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shape(got) == plain_trie(rows)


def odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(90, 130), 250, 307, 1000, -5, -250, 10**15 + 7, 10**15]:
        n = rng.choice([0, 1, 1, 2, 3, 5, 9, 14])
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", None, "", "äö", "long " * 50])))
    rows += [(None, 1, "user", "no conversation"), (400, 0, "user", "x"), (400, 0, "user", "x"), (401, None, None, None)]
    rows += [(500, i, "user", "again") for i in range(40)] + [(501, i, "user", "again") for i in range(25)] + [(502 + i, j, "u", "t") for i in range(60) for j in range(3)]
    return rows


@pytest.mark.parametrize("seed,block,small", [(1, 4096, 1 << 14), (2, 3, 4), (3, 7, 1)])
def test_odd_tables_in_small_blocks_and_many_rounds(spark, monkeypatch, seed, block, small):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "depth": F.lit("x"), "a": F.lit(2), "rank": F.lit(0)}).repartition(6)
    got = trie.prefix_trie(df, small=small).cache()
    assert shape(got) == plain_trie(rows)
    # each arc has a place of its own, and a node's arcs enclose those of its subtree
    places = sorted(x for r in got.collect() for x in (r.enter_at, r.exit_at))
    assert places == list(range(2 * got.count()))
    up = {(r.conv_id, r.depth): r for r in got.collect()}
    for r in up.values():
        if r.depth:
            p = up[r.parent_conv_id, r.depth - 1]
            assert p.enter_at < r.enter_at < r.exit_at < p.exit_at


def test_empty_table(spark):
    empty = trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(700, 760)]  # the first turn of most is replaced by one that isn't there
    rows = [r for r in rows if r[0] != 700]
    got = shape(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_trie(rows) and got[701, 0][1] == 59


def test_conversations_that_go_on_in_other_ranges(spark):
    """Many ranges, none put together: long conversations are counted across several tasks."""
    rows = [(c, t, "user", f"{t % 7}") for c in (100, 101, 150) for t in range(300)] + [(100, None, "user", "first"), (7, 1, "a", "b")]
    keys = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        ranked = trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(5)).groupBy("conv_id").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.count(F.lit(1)).alias("n")).collect()
        assert all(r.r == list(range(1, r.n + 1)) for r in ranked) and {r.conv_id: r.n for r in ranked} == {100: 301, 101: 300, 150: 300, 7: 1}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
