"""Mixing sources to target weights by Pfair scheduling (operator 9).

Documents of a source are put in a hashed order and cut into blocks of ``block`` documents.  With weight
w, the source's j-th block (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w);
each slot goes to the released block with the earliest deadline (then of the heavier source, then by
name), so after any number t of slots a source has had less than one block more or less than w * t.
Weights are exact, in whole numbers of any size; only with ``period`` they are first rounded to multiples
of 1 / ``period``.  A source whose blocks run out starts again (epoch 1, 2, ...).

The schedule is written as a table, in stretches of ``stretch`` slots (or four windows of the lightest source, if that
is more), each by a task of its own as a stream that holds one entry for each source.  Tasks agree on the turns that
each source has had where stretches meet (``turns_at``), so no task waits for another, and the schedule as a whole
meets every release and deadline.

By default weights follow the sources' document counts to the power ``temperature``, and the mix is just
as long as it takes for every source to come through once: no document is left out, and small sources
repeat.  The index of a document in its source is a running count inside hashed bins, of about ``bin_rows``
documents each, plus the sizes of the bins before, so that no source meets in one task.

The hashed order is that of all columns (but maps), so rows that share a doc_id, or have none, are spread as well.

Defined results: rows without a source form a source of their own (null); repeated rows are different
documents of the mix; an empty table gives an empty mix; other columns are
carried along, but those named slot, epoch, block_no or place, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymesh.llm.frames import written

ADDED = ["slot", "epoch", "block_no", "place"]
PLAN = "__no bigint, block_no bigint, epoch bigint, __far bigint, slot bigint"
#: epochs of a block that are joined by one key
TOGETHER = 64
#: sources whose facts (four small values each) are sent to all tasks; those of more are joined
FEW = 100_000


def shares(weights: Mapping, period: int) -> dict:
    """Slots of each source in one period: the weights to the nearest whole, at least 1, in sum ``period``."""
    total = sum(weights.values())
    exact = {k: period * v / total for k, v in weights.items()}
    slots = {k: max(1, math.floor(v)) for k, v in exact.items()}
    by_rest = sorted(slots, key=lambda k: (slots[k] - exact[k], str(k)))
    i = 0
    while sum(slots.values()) < period:
        slots[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(slots.values()) > period:
        largest = max((k for k in slots if slots[k] > 1), key=lambda k: (slots[k] - exact[k], slots[k], str(k)))
        slots[largest] -= 1
    return slots


def whole(weights: Mapping) -> dict:
    """Whole numbers in exactly the proportions of ``weights``; the heaviest source first, then by name."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    unit = math.lcm(*(v.denominator for v in exact.values()))
    return {k: int(exact[k] * unit) for k in sorted(exact, key=lambda k: (-exact[k], k is not None, str(k)))}


def schedule(weight: Sequence[int], slots: int, start: int = 0, had: Sequence[int] | None = None, goal: Sequence[int] | None = None) -> Iterator[tuple[int, int]]:
    """(number of the source, turn) of each slot from ``start`` to ``slots``: the earliest deadline among released
    turns.  ``had``: turns that each source has had at ``start``; ``goal``: those it must have had at the end."""
    total = sum(weight)

    def due(i: int, j: int) -> int:
        end = -(-(j + 1) * total // weight[i])
        return end if goal is None else min(end, slots)

    waiting = [(j * total // weight[i], due(i, j), i, j) for i, j in enumerate(had or [0] * len(weight)) if goal is None or j < goal[i]]
    heapify(waiting)
    ready: list = []
    for t in range(start, slots):
        while waiting and waiting[0][0] <= t:
            heappush(ready, heappop(waiting)[1:])
        _, i, j = heappop(ready)
        yield i, j
        j += 1
        if goal is None or j < goal[i]:
            heappush(waiting, (j * total // weight[i], due(i, j), i, j))


def lead_in(weight: Sequence[int]) -> int:
    """Slots of the longest window between release and deadline of any turn, but for rounding."""
    return -(-sum(weight) // min(weight))


def turns_at(weight: Sequence[int], t: int) -> list[int]:
    """Turns that each source has had at slot ``t``, from which all deadlines before and after ``t`` can be met.

    At the slot ``lead_in`` earlier, each source has had its exact share rounded down; what is left over of the slots
    goes to the begun turns of earliest deadline, so that none of the turns that come can be late.  From there on
    turns follow by deadline.  All windows that reach over ``t`` begin in between, so that turns before fit as well.
    """
    total, start = sum(weight), max(0, t - lead_in(weight))
    had = [start * w // total for w in weight]
    begun = sorted((-(-(j + 1) * total // w), i) for i, (j, w) in enumerate(zip(had, weight, strict=True)) if start * w % total)
    for _, i in begun[: start - sum(had)]:
        had[i] += 1
    for i, j in schedule(weight, t, start, had):
        had[i] = j + 1
    return had


def _planned(batches, weight: list[int], blocks: list[int], slots: int, length: int):
    count = np.array(blocks, np.int64)
    for k in (k for b in batches for k in b.column(0).to_pylist()):
        t, stop = k * length, min(slots, (k + 1) * length)
        own = schedule(weight, stop, t, turns_at(weight, t), turns_at(weight, stop) if stop < slots else None)
        while part := list(islice(own, 1 << 16)):
            source, turn = np.array(part, np.int64).T
            epoch = turn // count[source]
            values = (source, turn % count[source], epoch, epoch // TOGETHER, np.arange(t, t + len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], [x.split()[0] for x in PLAN.split(", ")])
            t += len(part)


def mixed(docs: DataFrame, weights: Mapping | None = None, block: int = 16, period: int | None = None, slots: int | None = None, temperature: float = 0.7, seed: int = 11, bin_rows: int = 1000, stretch: int = 1 << 18) -> DataFrame:
    """The mix: a row for each document and epoch, with its ``slot`` and its ``place`` (a dense order of
    whole blocks is slot, place)."""
    spark = docs.sparkSession
    own = docs.drop(*ADDED)
    own = own.withColumn("__key", F.xxhash64(*(F.col(f"`{f.name}`") for f in own.schema if "map<" not in f.dataType.simpleString()), F.lit(seed)))
    count = {r.source: r.n for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = {k: n**temperature for k, n in count.items()}
    weights = {k: w for k, w in weights.items() if w > 0 and count.get(k)}
    if not weights:
        return own.drop("__key").limit(0).select("*", *(F.lit(0).cast("bigint").alias(x) for x in ADDED))
    if period is not None:
        if period < len(weights):
            raise ValueError(f"a period of {period} slots can't hold {len(weights)} sources")
        weights = shares(weights, period)
    weight = whole(weights)
    total = sum(weight.values())
    blocks = {k: -(-count[k] // block) for k in weight}
    if slots is None:
        slots = max(-(-blocks[k] * total // weight[k]) for k in weight)

    # what holds for each source of the mix: as many rows as it has sources
    epochs = {k: -(-slots * weight[k] // total) // blocks[k] for k in weight}
    facts = spark.createDataFrame([(k, i, epochs[k] // TOGETHER, -(-count[k] // bin_rows)) for i, k in enumerate(weight)], "__source string, __no bigint, __most bigint, __bins bigint")
    if len(weight) <= FEW:
        facts = F.broadcast(facts)
    own = own.join(facts, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    # the index of each document in its source; bins are ranges of the hashed order
    bin_no = F.floor((F.shiftrightunsigned("__key", 33).cast("double") / F.lit(float(1 << 31))) * F.col("__bins")).cast("bigint")
    own = own.withColumn("__bin", bin_no)
    sizes = written(own.groupBy("__no", "__bin").agg(F.count(F.lit(1)).alias("n")), "mix-bins")
    before = sizes.select("__no", "__bin", (F.sum("n").over(Window.partitionBy("__no").orderBy("__bin")) - F.col("n")).alias("__before"))
    ordered = Window.partitionBy("__no", "__bin").orderBy("__key", "doc_id")
    numbered = own.withColumn("__n", F.row_number().over(ordered)).join(before, ["__no", "__bin"])
    index = F.col("__before") + F.col("__n") - 1

    # a row for each slot, met by the documents of its block
    length = max(stretch, 4 * lead_in(list(weight.values())))
    n = -(-slots // length)
    stretches = spark.range(0, n, 1, min(n, 20_000))
    plan = written(stretches.mapInArrow(partial(_planned, weight=list(weight.values()), blocks=list(blocks.values()), slots=slots, length=length), PLAN), "mix-plan")
    out = numbered.withColumn("block_no", F.floor(index / block).cast("bigint")).withColumn("place", index % block)
    out = out.withColumn("__far", F.explode(F.sequence(F.lit(0).cast("bigint"), "__most")))
    out = out.join(plan, ["__no", "block_no", "__far"])
    return out.select(*(f"`{c}`" for c in docs.columns if c not in ADDED), *ADDED)
