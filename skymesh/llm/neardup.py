"""Near-duplicate documents by min-max hashing (operator 7).

Each document's set of word shingles is hashed under ``permutations`` permutations, and both the least
and the greatest value under each are kept, so half the hash evaluations give a signature of twice the
length.  The signature is cut into bands; documents that share a band are candidates, and every link is
confirmed on full sets.  With the defaults (90 permutations, 180 values, 36 bands of 5) a pair with
similarity 0.85 shares no band with probability (1 - 0.85^5)^36 < 1e-9.

Documents with equal sets are one class and only its first document goes on.  A band shared by many
classes isn't expanded into pairs: its most connected class is compared with all others (a star), what is
linked is put into one component, and only where a band still holds several components the next star
is drawn among those that no star has reached.  After ``stars`` rounds every pair of classes that share a
band and are in different components is looked at, in the first band that both have: a second, longer
min-max sketch (four bits of each of 1024 values), which only these classes get, rules out the pairs whose
estimated similarity is 6 standard deviations below what a link needs, and all others are confirmed on
full sets.  So no link is lost, however a group is built.

Components are found by repeated least-label steps; labels, links and sets stay in Spark.

Defined results: texts without words (null, empty, blank) have an empty set and are linked with nothing;
rows that share a doc_id but not their text are documents of their own
(so each of them links, and a component's id is the least doc_id of its rows); rows without doc_id are left out of comparisons and
kept, with a null component; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.llm.frames import apart, texts, written
from skymesh.llm.kernel import NOT_SPACE, Words, int64, mix, slices, span_hash, text_bytes

SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
RESULT = "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"


def shingles(part: pa.RecordBatch, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, one after the other, and where each begins."""
    words = Words(*text_bytes(part.column("text")), NOT_SPACE, lower=lower)
    at, name = words.windows(size)
    doc = words.doc[at]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    name = np.concatenate([name, span_hash(words.sequence, words.first[few], words.first[few + 1])])
    doc = np.concatenate([doc, few])
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    name, doc = name[new], doc[new]
    return name, np.searchsorted(doc, np.arange(part.num_rows + 1))


def _signed(batches, size: int, permutations: int, rows: int):
    salts = np.random.default_rng(7).integers(1, 1 << 63, permutations, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch):
            name, begin = shingles(part, size)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            bands = np.zeros((part.num_rows, 2 * permutations // rows), np.uint64)
            a = np.zeros(part.num_rows, np.uint64)
            b = a.copy()
            if len(full):
                cut = begin[full]
                values = np.empty((2 * permutations, len(full)), np.uint64)
                for i, salt in enumerate(salts):
                    own = (name ^ salt) * (salt << np.uint64(1) | np.uint64(1))
                    values[2 * i] = np.minimum.reduceat(own, cut)
                    values[2 * i + 1] = np.maximum.reduceat(own, cut)
                # the two ends of one permutation go to different bands
                grid = np.concatenate([values[0::2], values[1::2]]).reshape(-1, rows, len(full))
                key = np.arange(len(grid), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.zeros(len(full), np.uint64)
                for r in range(rows):
                    key = mix(key ^ grid[:, r])
                bands[full] = key.T
                a[full] = np.add.reduceat(mix(name), cut)
                b[full] = np.bitwise_xor.reduceat(mix(name + np.uint64(11)), cut)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands.shape[1]), int64(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int64(n), int64(a), int64(b), lists], [x.split()[0] for x in SIGNED.split(", ")])


def _sets(batches, size: int):
    for batch in batches:
        for part in slices(batch):
            name, begin = shingles(part, size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), int64(name))], ["doc_id", "items"])


SKETCH = 512  # permutations: 1024 values of four bits, 64 longs


def _sketched(batches):
    salts = np.random.default_rng(8).integers(1, 1 << 63, SKETCH, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = part.column("items")
            name, cut = sets.flatten().to_numpy().view(np.uint64), (sets.offsets.to_numpy() - sets.offsets[0].as_py())[:-1]
            values = np.empty((2 * SKETCH, part.num_rows), np.uint64)
            for i, salt in enumerate(salts):
                own = (name ^ salt) * (salt << np.uint64(1) | np.uint64(1))
                values[i], values[SKETCH + i] = np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)
            four = (mix(values) & np.uint64(15)).reshape(-1, 16, part.num_rows)
            packed = np.zeros((len(four), part.num_rows), np.uint64)
            for k in range(16):
                packed |= four[:, k] << np.uint64(4 * k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(four)), int64(packed.T.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "sketch"])


def differing(x: str, y: str) -> str:
    """SQL: how many of the sixteen four-bit values of two longs differ."""
    d = f"({x} ^ {y})"
    pairs = f"({d} | shiftrightunsigned({d}, 1))"
    return f"bit_count(({pairs} | shiftrightunsigned({pairs}, 2)) & 1229782938247303441L)"


def apart_pairs(open_: DataFrame, bands: DataFrame, items: DataFrame, similar: int, n_bands: int) -> DataFrame:
    """(a, b): classes of different components with a common band that their sketches don't rule out."""
    nodes = written(open_.select("node").distinct(), "minmax-apart")
    own = items.withColumnRenamed("doc_id", "node").join(nodes, "node").select("node", "items").mapInArrow(_sketched, "node bigint, sketch array<bigint>")
    wide = own.join(bands, "node").select("node", *(F.col("bands")[i].alias(f"b{i}") for i in range(n_bands)), *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 8)))
    side = open_.select("band", "node", "n_shingles", "label").join(wide, "node")
    side = written(side.withColumn("nth", F.array_position(F.array(*(f"b{i}" for i in range(n_bands))), F.col("band"))), "minmax-sides")
    other = side.select("band", *(F.col(c).alias(f"{c}_o") for c in side.columns if c != "band"))
    values = 2 * SKETCH
    p = similar / 100 + (1 - similar / 100) / 16
    least = p * values - 6 * (values * p * (1 - p)) ** 0.5
    earlier = " or ".join(f"(nth > {i + 1} and b{i} = b{i}_o)" for i in range(n_bands - 1))
    far = " + ".join(differing(f"s{i}", f"s{i}_o") for i in range(SKETCH // 8))
    rule = f"node < node_o and label != label_o and 100 * least(n_shingles, n_shingles_o) >= {similar} * greatest(n_shingles, n_shingles_o) and not ({earlier}) and {far} <= {values - least}"
    return side.join(other, "band").filter(rule).select(F.col("node").alias("a"), F.col("node_o").alias("b"))


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """The least node reachable from each of ``nodes`` (node) over ``links`` (a, b): (node, label)."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), name)
    labels = written(nodes.select("node", F.col("node").alias("label")), name)
    while True:
        told = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(told, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("next"))
        # one jump along the label: the label's own label
        own = labels.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        step = near.join(own, near.next == own.of, "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), (F.least("next", F.coalesce("jump", "next")) != F.col("label")).alias("changed"))
        step = written(step, name)
        labels = step.select("node", "label")
        if step.filter("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, size: int = 3, similar: int = 85, permutations: int = 90, rows: int = 5, stars: int = 2) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the size of its shingle set, the least doc_id
    reachable over links of Jaccard similarity ``similar`` per cent, and whether that is its own."""
    own = texts(docs)
    again = written(own.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "minmax-ids")
    if again.isEmpty():
        return _grouped(own, size, similar, permutations, rows, stars)
    # rows of one id are told apart by a name that their text gives them, and components get the least id of their rows
    name = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    named = written(own.join(again.withColumn("shared", F.lit(True)), "doc_id", "left").select(F.when(F.col("shared"), name).otherwise(F.col("doc_id")).alias("doc_id"), "text", F.col("doc_id").alias("own_id")), "minmax-named")
    got = written(_grouped(named.select("doc_id", "text"), size, similar, permutations, rows, stars).withColumnRenamed("doc_id", "name"), "minmax-rows")
    ids = named.select(F.col("doc_id").alias("name"), "own_id").filter("own_id is not null").distinct()
    rows_ = got.join(ids, "name", "left")
    least = rows_.filter("component_id is not null").groupBy("component_id").agg(F.min("own_id").alias("least"))
    out = rows_.join(least, "component_id", "left")
    return out.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("least") == F.col("own_id"), F.lit(True)).alias("kept"))


def _grouped(own: DataFrame, size: int, similar: int, permutations: int, rows: int, stars: int) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text) whose ids are those of their texts."""
    known = own.filter("doc_id is not null")
    signed = written(own.mapInArrow(partial(_signed, size=size, permutations=permutations, rows=rows), SIGNED), "minmax")
    named = signed.filter("doc_id is not null")
    classes = written(named.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node")), "minmax-classes")

    # bands with several classes, and how connected each class is
    heads = signed.select("doc_id", "n_shingles", "bands").join(classes.select("node").withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    member = heads.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(member.join(apart(shared), "band").select("band", "node", "n_shingles", "n"), "minmax-bands")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"), F.first("n_shingles").alias("size"))
    weight = written(weight, "minmax-weight")
    items = known.join(weight.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, size=size), "doc_id bigint, items array<bigint>")
    items = written(items, "minmax-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
        right = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
        return met.filter(100 * F.col("both") >= similar * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")

    sizes = lambda x, y: F.expr(f"100 * least({x}, {y}) >= {similar} * greatest({x}, {y})")  # noqa: E731  what any link needs
    nodes = written(weight.select("node"), "minmax-nodes")
    links, labels = None, nodes.select("node", F.col("node").alias("label"))
    open_ = members.join(weight.select("node", "weight"), "node").select("band", "node", "n_shingles", "weight", F.col("node").alias("label"), F.lit(False).alias("reached"))
    for _ in range(stars):
        # the hub of each band: of the classes that no star has reached, the most connected
        best = F.max(F.struct("weight", (-F.col("node")).alias("node"), "n_shingles", "label")).alias("h")
        hubs = open_.filter("not reached").groupBy("band").agg(best).select("band", (-F.col("h.node")).alias("hub"), F.col("h.n_shingles").alias("hub_size"), F.col("h.label").alias("hub_label"))
        hubs = written(hubs, "minmax-hubs")
        met = open_.join(hubs, "band").filter((F.col("label") != F.col("hub_label")) & sizes("n_shingles", "hub_size"))
        pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        new = written(confirmed(pairs), "minmax-links")
        links = new if links is None else links.unionByName(new)
        labels = components(nodes, links, "minmax-labels")
        # a band is done once it holds one component
        at = open_.drop("label").join(labels, "node")
        several = at.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band")
        of_hub = hubs.select("band", "hub").join(labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub").join(several, "band", "left_semi").select("band", "hub_label")
        reached = F.col("reached") | (F.col("label") == F.col("hub_label"))
        open_ = written(at.join(apart(of_hub), "band").select("band", "node", "n_shingles", "weight", "label", reached.alias("reached")), "minmax-open")
        if open_.isEmpty():
            break
    else:
        bands = signed.select(F.col("doc_id").alias("node"), "bands").dropDuplicates(["node"])
        pairs = apart_pairs(open_, bands, items, similar, 2 * permutations // rows)
        new = written(confirmed(pairs), "minmax-links")
        if not new.isEmpty():
            labels = components(nodes, new if links is None else links.unionByName(new), "minmax-labels")
    placed = classes.join(labels, "node", "left").select("set_a", "set_b", F.col("n_shingles").alias("n"), F.coalesce("label", "node").alias("least"))
    same = (signed.set_a == F.col("p_a")) & (signed.set_b == F.col("p_b")) & (signed.n_shingles == F.col("n"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(apart(placed.withColumnsRenamed({"set_a": "p_a", "set_b": "p_b"})), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
