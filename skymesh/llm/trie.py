"""The prefix trie of conversations and its subtree sums, by an Euler tour (operator 13).

Conversations are rebuilt first: the first h turns of the conversation that opens a hundred (``conv_id - conv_id %
100``), then their own turns after their first h.  A node is a sequence of first turns that some rebuilt
conversation has; it is named by the smallest of its members and its depth.

Steps, each a join, a grouping or a window:

1. Turns are numbered over ranges of (conv_id, turn): each task counts inside its range, and a conversation that goes on
   in another range is carried on there.  From here on a turn is two 64-bit hashes and a length.
2. A prefix has the two running exclusive-ors of its turns' hashes with their places; equal prefixes are one group.
3. Of the tour's arcs, an enter and an exit of each node, those that certainly follow each other are joined: a node's
   smallest member goes on to its first child, so the nodes of one smallest member are a chain, entered as one and left in
   runs between the nodes where other chains leave it.  Other children follow one another by a hash of their member.
4. The tour is ranked as a list: in rounds, each element with tails takes in a successor with heads, until ``SMALL``
   elements are left for one task; then the rounds are undone.  This gives the arcs, leaves and savings before each
   element.  What stands between a node's enter and exit arcs is its subtree.

Windows go over blocks of ``BLOCK`` rows and carry block totals on, so neither a long conversation nor a node with
many children is one task's work.  Each step that is read twice is a written table.

Defined results: rows without conv_id are left out; a null role or text is empty; turns with one number follow
each other by role, then text, and repeated rows are turns of their own; a conversation of no rebuilt turn is a
member of the root only; ids below 0 open hundreds towards 0, as SQL's remainder does; other columns are
ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymesh.llm.frames import small_batches, written

BLOCK = 4096
SMALL = 1 << 14
HUNDRED = 100
KEEP = 6

NODE = ["depth", "x1", "x2"]
TOUR = ["arcs", "leaves", "saved"]
EMPTY = hashlib.sha256(b"").hexdigest()


# -- windows in blocks ----------------------------------------------------------------------------
def running(df: DataFrame, keys: list[str], block: Column, order: Column, fold, join, value: Column, name: str) -> DataFrame:
    """``df`` with the running ``fold`` (an aggregate) of ``value`` in the order of ``block``, then ``order``, for each of
    ``keys``; ``join`` puts what earlier blocks give (or null) and what this block gives together."""
    own = df.withColumns({"__b": block, "__v": value})
    rows = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = own.groupBy(*keys, "__b").agg(fold("__v").alias("__t"))
    earlier = blocks.select(*keys, "__b", fold("__t").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__e"))
    met = own.withColumn("__i", fold("__v").over(rows)).join(earlier.filter("__e is not null"), [*keys, "__b"], "left")
    return met.withColumn(name, join(F.col("__e"), F.col("__i"))).drop("__b", "__v", "__i", "__e")


def following(df: DataFrame, keys: list[str], block: Column, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the ``value`` of the next row in the order of ``block``, then ``order``, for each of ``keys``."""
    own = df.withColumns({"__b": block, "__o": order, "__v": value})
    inside = F.lead("__v").over(Window.partitionBy(*keys, "__b").orderBy("__o"))
    heads = own.groupBy(*keys, "__b").agg(F.min(F.struct("__o", "__v"))["__v"].alias("__h"))
    later = heads.select(*keys, "__b", F.lead("__h").over(Window.partitionBy(*keys).orderBy("__b")).alias("__n"))
    met = own.withColumn("__i", inside).join(later, [*keys, "__b"])
    return met.withColumn(name, F.coalesce("__i", "__n")).drop("__b", "__o", "__v", "__i", "__n")


# -- turns ----------------------------------------------------------------------------------------
def _counted(batches):
    """The place of each row among those of its conversation in this task's range."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy()
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
        if last == conv[0]:
            place[: first[1] if len(first) > 1 else None] += count
        last, count = conv[-1], place[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), *b.columns, pa.array(place, pa.int64())], ["part", *b.schema.names, "place"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, m1, m2, size): the turns in order, from 1; two hashes of role and text, and the text's length."""
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    own = small_batches(conversations).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), *text.values()).filter("conv_id is not null")
    turn = F.col("turn").asc_nulls_first()
    own = own.repartitionByRange("conv_id", turn).sortWithinPartitions("conv_id", turn, "role", "text")
    own = own.select("conv_id", *(F.xxhash64(F.lit(k), "role", "text").alias(k) for k in ("m1", "m2")), F.length("text").cast("bigint").alias("size"))
    own = written(own.mapInArrow(_counted, "part int, conv_id bigint, m1 bigint, m2 bigint, size bigint, place bigint"), "turns")
    parts = own.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range goes on with one conversation at most: no more rows than ranges
    carried = parts.select("conv_id", "part", earlier.alias("earlier")).filter("earlier is not null")
    return own.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("rank"), "m1", "m2", "size")


def rebuilt(conversations: DataFrame, hundred: int = HUNDRED, keep: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, m1, m2, size, length) and all conversations (conv_id, length)."""
    turns = numbered(conversations)
    counts = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(keep))
    own = counts.withColumns({"base": F.col("conv_id") - F.col("conv_id") % hundred, "h": shared})
    opening = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("have"))
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    convs = own.join(opening, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "rebuilt")
    first = turns.filter(F.col("rank") < keep).withColumnRenamed("conv_id", "base").join(convs, "base").filter("rank <= taken")
    rest = turns.join(convs, "conv_id").filter("rank > h")
    cols = ["m1", "m2", "size", "length"]
    out = first.select("conv_id", F.col("rank").alias("pos"), *cols).unionByName(rest.select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("pos"), *cols))
    return out, convs.select("conv_id", "length")


# -- nodes ----------------------------------------------------------------------------------------
def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, size, last): the hashes of each prefix and of the prefix before it."""
    xor = lambda e, i: F.when(e.isNull(), i).otherwise(e.bitwiseXOR(i))
    out = turns
    for x, m in (("x1", "m1"), ("x2", "m2")):
        out = running(out, ["conv_id"], F.floor(F.col("pos") / BLOCK), F.col("pos"), F.bit_xor, xor, F.xxhash64("pos", m), x)
    before = (F.col(x).bitwiseXOR(F.xxhash64("pos", m)).alias(p) for x, m, p in (("x1", "m1", "p1"), ("x2", "m2", "p2")))
    return out.select("conv_id", F.col("pos").alias("depth"), "x1", "x2", *before, "size", (F.col("pos") == F.col("length")).alias("last"))


def _joined(batches):
    """Of each run of one node in a batch, in lots of ``BLOCK``: the first id and all ids as text."""
    for b in batches:
        if not b.num_rows:
            continue
        node = np.stack([b.column(c).to_numpy() for c in NODE])
        edge = np.append(True, (node[:, 1:] != node[:, :-1]).any(0))
        start = np.flatnonzero(edge)
        edge[np.concatenate([np.arange(a, z, BLOCK) for a, z in zip(start, np.append(start[1:], len(edge)), strict=True)])] = True
        start = np.flatnonzero(edge)
        ids = b.column("conv_id").to_numpy()
        lots = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(start)) for c in NODE), pa.array(ids[start]), pa.array(lots)], [*NODE, "conv_id", "ids"])


def _hashed(batches):
    """SHA-256 of the lots of each node, which come in order: only the hash's state is held."""
    now, state, out = None, None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])

    for b in batches:
        for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if node != now:
                if state:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield row()
            out = []
    if state:
        out = [(*now, state.hexdigest())]
        yield row()


def ends(members: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the conversations (depth, x1, x2, conv_id) that end at a node, ids in order."""
    lots = members.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined, "depth bigint, x1 bigint, x2 bigint, conv_id bigint, ids string")
    return lots.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_hashed, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def nodes_of(conversations: DataFrame) -> DataFrame | None:
    """(conv_id, depth, parent, n_convs, size, ends_sha256): the trie's nodes; none for an empty table."""
    turns, convs = rebuilt(conversations)
    own = written(prefixes(turns), "prefixes")
    whole = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not whole[1]:
        return None
    groups = own.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.max(c).alias(c) for c in ("size", "p1", "p2")))
    groups = written(groups, "groups")
    zero = F.lit(0).cast("bigint")
    root = convs.limit(1).select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(whole[0]).cast("bigint").alias("conv_id"), F.lit(whole[1]).cast("bigint").alias("n_convs"), zero.alias("size"), F.lit(None).cast("bigint").alias("parent"))
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    deep = groups.filter("depth > 1").join(above, ["depth", "p1", "p2"])
    cols = [*NODE, "conv_id", "n_convs", "size", "parent"]
    all_ = root.select(*cols).unionByName(groups.filter("depth = 1").withColumn("parent", F.lit(whole[0]).cast("bigint")).select(*cols)).unionByName(deep.select(*cols))
    members = own.filter("last").select(*NODE, "conv_id").unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    out = all_.join(ends(members), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return written(out.select("conv_id", "depth", "parent", "n_convs", "size", "ends_sha256"), "nodes")


# -- list ranking ---------------------------------------------------------------------------------
def _solved(batches, small: int):
    """Sums before each element of a whole list of at most ``small`` elements, by pointer jumping from the back."""
    lots = [x for x in batches if x.num_rows]
    if not lots:
        return
    table = pa.Table.from_batches(lots)
    a, b, na, nb = (table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "na", "nb"))
    n = len(a)
    if n > small:
        raise ValueError(f"{n} elements are left, not {small}")
    at = {(x, y): i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
    follow = np.array([at.get((x, y), n) for x, y in zip(na.tolist(), nb.tolist(), strict=True)] + [n], np.int64)
    own = np.array([[*table.column(c).to_pylist(), 0] for c in TOUR], np.int64)
    rest = own.copy()  # of an element and all after it, once every pointer is at the end
    for _ in range(max(1, n.bit_length() + 1)):
        rest = rest + rest[:, follow] * (follow < n)
        follow = follow[follow]
    total = rest.max(1, initial=0)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(total[i] - rest[i, :n]) for i in range(len(TOUR)))], ["a", "b", *TOUR])


def sums_before(elements: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b, arcs, leaves, saved): the sums of all elements before (a, b) in a list (a, b, na, nb, arcs, leaves, saved), in
    which (na, nb) follows (a, b)."""
    coin = lambda x, y, k: F.xxhash64(F.lit(k), x, y) % 2 == 0
    now, rounds, left = elements, [], elements.count()
    while left > small:
        k = len(rounds)
        takes = now.filter(~coin("a", "b", k) & F.col("na").isNotNull() & coin("na", "nb", k))
        taken = takes.select(F.col("na").alias("a"), F.col("nb").alias("b"), F.struct("a", "b", *TOUR).alias("by"))
        met = written(now.join(taken, ["a", "b"], "left"), f"round-{k}")
        rounds.append(met.filter("by is not null").select("a", "b", "by"))
        stay = met.filter(F.col("by").isNull() & ~F.coalesce(~coin("a", "b", k) & coin("na", "nb", k) & F.col("na").isNotNull(), F.lit(False)))
        grown = met.filter("by is not null").select("by.a", "by.b", "na", "nb", *((F.col(f"by.{c}") + F.col(c)).alias(c) for c in TOUR))
        now = stay.select(*grown.columns).unionByName(grown)
        left = now.count()
    out = now.coalesce(1).mapInArrow(partial(_solved, small=small), "a bigint, b bigint, arcs bigint, leaves bigint, saved bigint")
    for k in reversed(range(len(rounds))):
        out = written(out, f"ranked-{k}")
        by = rounds[k].select("a", "b", F.col("by.a").alias("ya"), F.col("by.b").alias("yb"), *(F.col(f"by.{c}").alias(f"y_{c}") for c in TOUR))
        ahead = out.select(F.col("a").alias("ya"), F.col("b").alias("yb"), *TOUR)
        out = out.unionByName(by.join(ahead, ["ya", "yb"]).select("a", "b", *((F.col(c) + F.col(f"y_{c}")).alias(c) for c in TOUR)))
    return out


# -- the trie -------------------------------------------------------------------------------------
def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    the places of its arcs in the tour (enter_at, exit_at)."""
    nodes = nodes_of(conversations)
    names = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, enter_at bigint, exit_at bigint"
    if nodes is None:
        return conversations.sparkSession.createDataFrame([], names)
    up = F.floor(F.col("depth") / BLOCK)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))

    # chains that leave another chain at (chain, at), each with the one that leaves there next
    light = written(nodes.filter("conv_id <> parent").select("conv_id", F.col("parent").alias("chain"), (F.col("depth") - 1).alias("at")), "chains")
    buckets = max(1, math.isqrt(light.count()))  # as many as there are chains in one of them at most, about
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(buckets))
    light = written(following(light, ["chain", "at"], bucket, F.col("conv_id"), F.col("conv_id"), "beside"), "siblings")
    opens = light.groupBy("chain", "at").agg(F.min(F.struct(bucket.alias("__b"), "conv_id"))["conv_id"].alias("opens"))
    opens = written(following(opens, ["chain"], -F.floor(F.col("at") / BLOCK), -F.col("at"), F.struct("at", "opens"), "above"), "branches")

    value = (F.col("n_convs") - 1) * F.col("size")
    here = opens.select(F.col("chain").alias("conv_id"), F.col("at").alias("depth"), F.col("at").alias("branch"))
    own = nodes.join(children, ["conv_id", "depth"], "left").join(here, ["conv_id", "depth"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "value": value})
    own = running(own, ["conv_id"], up, F.col("depth"), F.sum, lambda e, i: F.coalesce(e, F.lit(0)) + i, F.col("value"), "upto")
    own = written(running(own, ["conv_id"], -up, -F.col("depth"), F.min, lambda e, i: F.least(e, i), F.col("branch"), "below"), "chained")

    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("value").alias("saved"), F.max("branch").alias("branch"), F.min("n_children").alias("least"))
    after = light.select("conv_id", F.coalesce("beside", "chain").alias("then"), F.when(F.col("beside").isNotNull(), -1).otherwise(F.col("at")).cast("bigint").alias("then_at"))
    chains = written(chains.join(after, "conv_id", "left"), "chain-ends")
    first = opens.select(F.col("chain").alias("conv_id"), F.col("at").alias("branch"), "opens", "above")
    down = F.lit(-1).cast("bigint")
    goes = lambda to, at: (F.coalesce(to, F.col("then")).alias("na"), F.when(to.isNotNull(), down).otherwise(F.col("then_at")).alias("nb"), at)
    whole = F.col("bottom") - F.col("top") + 1
    enters = chains.join(first, ["conv_id", "branch"], "left").select(F.col("conv_id").alias("a"), down.alias("b"), *goes(F.col("opens"), (whole + F.coalesce(F.col("bottom") - F.col("branch"), whole)).alias("arcs")), F.when(F.col("least") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), "saved")
    exits = first.join(chains.select("conv_id", "top", "then", "then_at"), "conv_id").select(F.col("conv_id").alias("a"), F.col("branch").alias("b"), *goes(F.col("above.opens"), (F.col("branch") - F.coalesce(F.col("above.at"), F.col("top") - 1)).alias("arcs")), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    sums = written(sums_before(written(enters.unionByName(exits), "tour"), small), "sums")

    enter = sums.filter("b = -1").select(F.col("a").alias("conv_id"), *(F.col(c).alias(f"e_{c}") for c in TOUR))
    leave = sums.filter("b >= 0").select(F.col("a").alias("conv_id"), F.col("b").alias("below"), *(F.col(c).alias(f"x_{c}") for c in TOUR))
    of_chain = enter.join(chains.select("conv_id", "top", "bottom", "saved"), "conv_id")
    met = own.join(of_chain, "conv_id").join(leave, ["conv_id", "below"], "left")
    # without a branch at or below the node, its subtree is the rest of its chain
    subtree = lambda c, none: F.coalesce(F.col(f"x_{c}"), F.col(f"e_{c}") + none)
    return met.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (subtree("leaves", F.lit(1)) - F.col("e_leaves")).alias("n_leaves"),
        (subtree("saved", F.col("saved")) - F.col("e_saved") - F.col("upto") + F.col("value")).alias("saved_tokens"),
        "ends_sha256",
        (F.col("e_arcs") + F.col("depth") - F.col("top")).alias("enter_at"),
        F.coalesce(F.col("x_arcs") + F.col("below") - F.col("depth"), F.col("e_arcs") + whole + F.col("bottom") - F.col("depth")).alias("exit_at"),
    )
