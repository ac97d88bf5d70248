"""Long verbatim repeats: the steps that recompression (operator 3) and suffix arrays (operator 6) share.

A *window* is a fixed number of units (words or bytes) of one document.  Each window has one *anchor*,
chosen from the window's own content, so equal windows have equal anchors; neighbouring windows of a
document that share an anchor occurrence form a *segment*.  The steps are

1. every slice of documents names its segments by two independent hashes of 64 bits (name, check), of which
   the first isn't a polynomial; equal segments of a slice are collapsed at once, so a
   passage that a third of all rows share sends one row for each slice instead of one for each document.
   An anchor with ``SEVERAL`` names or more in one slice (the edge of a common passage, where every document
   goes on differently) sends one mark for this slice, and its segments are dealt by name;
2. all other segments are dealt by anchor.  Both are read in order of (anchor, kind, name, check, document,
   start).  A later copy of a segment is a repeat as a whole.  Of the other segments only those whose anchor
   also has a differently named segment, or a mark, can hold a window that exists elsewhere: the candidates.
   Equal segments that are dealt in two ways all become candidates;
3. candidates meet their texts again (one join on doc_id) and their windows are compared exactly;
4. spans to remove are grouped by document and applied to the text (a second join on doc_id).

All of a document's windows are judged on the input.  Nothing is capped; step 2 reads its rows as a
stream, in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skymesh.llm.frames import apart
from skymesh.llm.kernel import int64, mix

#: at: start << 24 | number of windows
SEGMENT = "anchor bigint, name bigint, check bigint, doc_id bigint, at bigint, kind tinyint"
JUDGED = "anchor bigint, doc_id bigint, at bigint, whole boolean"
BITS = 24
MASK = (1 << BITS) - 1
#: kinds of rows: dealt by anchor; a repeat already; dealt by name, its anchor has several; says so of an anchor
PLAIN, WHOLE, NAMED, MARK = range(4)
SEVERAL = 4


def columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def batch(schema: str, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) if v.dtype in (bool, np.int8) else int64(v) for v in values], columns(schema))


def runs(pick: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring windows of one document with the same anchor: index and length."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def touching(group: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows, in order of group and start, with those that touch in one group put together: the first
    row of each, where it starts, its windows.  A longer run than ``MASK`` windows becomes several spans, one
    after the other."""
    if not len(group):
        return np.zeros(0, np.int64), start, n
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    begin, end = start[first], np.maximum.reduceat(start + n, first)
    pieces = np.maximum(1, -(-(end - begin) // MASK))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + nth * MASK
    return np.repeat(first, pieces), begin, np.minimum(np.repeat(end, pieces) - begin, MASK)


def joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows (in any order), with those that touch in one document put together."""
    order = np.lexsort((start, doc))
    row, begin, n = touching(doc[order], start[order], n[order])
    return doc[order][row], begin, n


def collapse(anchor, name, check, doc, start, n, same_doc: bool) -> Iterator[pa.RecordBatch]:
    """The segments of a slice: the first of each name goes on, later copies are repeats already."""
    key = mix(anchor ^ mix(name ^ mix(check)))
    order = np.lexsort((start, doc, key))
    key, anchor, name, check, doc, start, n = (x[order] for x in (key, anchor, name, check, doc, start, n))
    if not len(key):
        return
    new = np.append(True, key[1:] != key[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    later = doc > doc[lead]
    if same_doc:
        later |= (doc == doc[lead]) & (start > start[lead])
        keep = new
    else:
        keep = ~later
    # names of each anchor in this slice
    by_anchor, names = np.unique(anchor[new], return_counts=True)
    marked = by_anchor[names >= SEVERAL]
    # of one document, equal segments that touch (a word again and again) go on as one
    own = np.cumsum(new | np.append(True, doc[1:] != doc[:-1]))
    row, begin, length = touching(own[keep], start[keep], n[keep])
    row = np.flatnonzero(keep)[row]
    kind = np.where(np.isin(anchor[row], marked), NAMED, PLAIN).astype(np.int8)
    yield batch(SEGMENT, anchor[row], name[row], check[row], doc[row], begin << BITS | length, kind)
    if len(marked):
        none = np.zeros(len(marked), np.int64)
        yield batch(SEGMENT, marked, none, none, none, none, np.full(len(marked), MARK, np.int8))
    if later.any():
        d, s, m = joined(doc[later], start[later], n[later])
        # a repeat already: dealt by its place, so that no task gets all copies of one passage
        place = mix(mix(d.astype(np.uint64)) + s.astype(np.uint64))
        yield batch(SEGMENT, place, place, place, d, s << BITS | m, np.full(len(d), WHOLE, np.int8))


def _judge(batches: Iterator[pa.RecordBatch], same_doc: bool) -> Iterator[pa.RecordBatch]:
    """Segments in order: later copies are repeats (whole); of the rest, those whose anchor has
    another name or a mark as well are candidates.  Holds back the segments of at most one name.
    Marks and segments dealt by name come first in their anchor."""
    anchor = name = check = doc = at = None  # of the newest name
    several = False  # the newest anchor has several names
    held: list[tuple[int, int, int]] = []  # its segments, while it has but one name
    for b in batches:
        a, m, c, d, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        kind = b.column(5).to_numpy(zero_copy_only=False)
        w = kind == WHOLE
        if w.any():
            yield batch(JUDGED, a[w], d[w], p[w], w[w])
            a, m, c, d, p, kind = a[~w], m[~w], c[~w], d[~w], p[~w], kind[~w]
        k = len(a)
        if not k:
            continue
        new_anchor = np.append(a[0] != anchor, a[1:] != a[:-1])
        new = new_anchor | np.append(m[0] != name or c[0] != check, (m[1:] != m[:-1]) | (c[1:] != c[:-1]))
        lead = np.maximum.accumulate(np.where(new, np.arange(k), -1))
        lead_doc = np.where(lead >= 0, d[lead], doc if doc is not None else 0)
        lead_at = np.where(lead >= 0, p[lead], at if at is not None else 0)
        later = d > lead_doc
        same = (d == lead_doc) & (p == lead_at) & ~new
        if same_doc:
            later |= (d == lead_doc) & (p > lead_at)
        # names of each anchor, in this batch
        group = np.cumsum(new_anchor)
        names = np.bincount(group, weights=new, minlength=group[-1] + 1)
        if not new_anchor[0]:
            names[0] += 1  # the name that came before
        many = (names > 1) | (np.bincount(group, weights=kind >= NAMED, minlength=group[-1] + 1) > 0)
        if not new_anchor[0]:
            many[0] |= several
        if held and (new_anchor[0] or many[0]):
            if many[0] and not new_anchor[0]:
                h = np.array(held, np.int64)
                yield batch(JUDGED, h[:, 0], h[:, 1], h[:, 2], np.zeros(len(h), bool))
            held = []
        later &= kind != MARK
        first = ~later & ~same & (kind != MARK)
        out = later | (first & many[group])
        yield batch(JUDGED, a[out], d[out], p[out], later[out])
        last = group == group[-1]
        if new_anchor.any():
            held = []
        if not many[group[-1]]:
            held += list(zip(a[last & first].tolist(), d[last & first].tolist(), p[last & first].tolist(), strict=True))
        several = bool(many[group[-1]])
        anchor, name, check = a[-1], m[-1], c[-1]
        doc, at = lead_doc[-1], lead_at[-1]


def judge(segments: DataFrame, same_doc: bool) -> DataFrame:
    """Repeats (whole) and candidates of ``segments``; dealt by anchor or name, sorted, read as a stream."""
    by = F.when(F.col("kind") == NAMED, F.xxhash64("anchor", "name", "check")).otherwise(F.col("anchor"))
    dealt = segments.repartition(by).sortWithinPartitions("anchor", F.desc("kind"), "name", "check", "doc_id", "at")
    return dealt.mapInArrow(partial(_judge, same_doc=same_doc), JUDGED)


def candidates(judged: DataFrame, most: int) -> DataFrame:
    """Of each document, its candidates; hot: the anchor has more than ``most`` of them."""
    own = judged.filter("not whole").select("anchor", "doc_id", "at")
    hot = apart(own.groupBy("anchor").count().filter(F.col("count") > most).select("anchor", F.lit(True).alias("hot")))
    flagged = own.join(hot, "anchor", "left").select("doc_id", F.struct("anchor", "at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("c"))
    return flagged.groupBy("doc_id").agg(F.collect_list("c").alias("cand"))


def with_spans(docs: DataFrame, spans: list[DataFrame], apply: Callable, schema: str | StructType) -> DataFrame:
    """``docs`` (doc_id, text) with the spans (doc_id, at) of each document, through ``apply``."""
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    grouped = every.groupBy("doc_id").agg(F.collect_list("at").alias("spans"))
    return docs.join(grouped, "doc_id", "left").mapInArrow(apply, schema)


def collapse_windows(key: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray, same_doc: bool):
    """Single windows of a slice, in order of content and place, and which of them come after the first of
    their content.  These get a key of their own place, so that no task gets all copies of one window."""
    order = np.lexsort((start, doc, check, key))
    key, check, doc, start = key[order], check[order], doc[order], start[order]
    if not len(key):
        return key, check, doc, start, np.zeros(0, bool)
    new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    later = doc > doc[lead]
    if same_doc:
        later |= (doc == doc[lead]) & (start > start[lead])
    return np.where(later, mix(doc.astype(np.uint64) + mix(start.astype(np.uint64))), key), check, doc, start, later


def later_windows(batches: Iterator, same_doc: bool, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Of windows in order of (key, check, document, start), those that come after the first of their content."""
    key = check = doc = start = None
    for k, c, d, s in batches:
        if not len(k):
            continue
        new = np.append(k[0] != key or c[0] != check, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        lead_doc = np.where(lead >= 0, d[lead], doc if doc is not None else 0)
        lead_start = np.where(lead >= 0, s[lead], start if start is not None else 0)
        later = d > lead_doc
        if same_doc:
            later |= (d == lead_doc) & (s > lead_start)
        yield emit(d[later], s[later])
        key, check, doc, start = k[-1], c[-1], lead_doc[-1], lead_start[-1]
