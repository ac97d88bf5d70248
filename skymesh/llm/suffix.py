"""Suffix arrays of byte shards by induced sorting, and substring dedup with them (operator 6).

``suffix_array`` classifies suffixes as smaller or larger than their right neighbour, takes the
leftmost-smaller (LMS) positions, sorts the LMS substrings by one induced pass, names them, orders the
reduced string of these names in the same way (recursively, until all names differ) and induces the order of
all suffixes.  The two induced passes visit the buckets of the first byte in order and move a whole bucket at
a time, so each suffix is moved once.  ``common_prefixes`` gives the permuted LCP array (in text order,
against the suffix that precedes in the array), as far as ``limit``.

The corpus is sharded by content: only segments that may hold a repeated window (see
:mod:`skymesh.llm.repeats`) go to the shards, all with one anchor to the same shard, so no two shards hold
equal windows.  Anchors with more than ``most`` differing segments would make one shard grow with the
corpus; their windows are dealt one by one, by their own content, and compared by two independent 64-bit names.

Defined results: a null or empty text has 0 bytes, 0 removed, and the hash of the empty string; texts
shorter than a window lose nothing; rows without doc_id take no part in comparisons and stay whole; rows
that share a doc_id are the same document (removed spans hold for each of them); other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skymesh.llm import repeats
from skymesh.llm.frames import small_batches, written
from skymesh.llm.kernel import BYTE_CODE, byte_hash, chain_hash, int64, mix, prefix, slices, span_hash, text_bytes

RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
ANCHOR = 24  # bytes
SHARD = 1 << 17  # bytes of segments that are sorted together


# -- suffix array ---------------------------------------------------------------------------------
def is_smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S type); the last one, a sentinel, is."""
    there = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)  # where the next value differs
    up = np.append(text[there[:-1] + 1] > text[there[:-1]], True)
    return np.repeat(up, np.diff(there, prepend=-1))


def _scatter(to: list[list], at: np.ndarray, first: np.ndarray) -> None:
    """Append the positions ``at`` to the buckets of their bytes ``first``, keeping their order."""
    if not len(at):
        return
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    cut = np.flatnonzero(np.diff(first)) + 1
    for piece, c in zip(np.split(at, cut), first[np.append(0, cut)].tolist(), strict=True):
        to[c].append(piece)


def _side(text, smaller, seeds: list[np.ndarray], size: int, up: bool) -> list[np.ndarray]:
    """One induced pass: the suffixes of the other type, by bucket, in order of the scan.  ``seeds``
    has, for each bucket, the known suffixes in order of the scan (``up``: left to right)."""
    arrived: list[list] = [[] for _ in range(size)]
    out: list[np.ndarray] = [seeds[0][:0]] * size
    for c in range(size) if up else range(size - 1, -1, -1):
        waves, wave = [], np.concatenate(arrived[c]) if arrived[c] else seeds[c][:0]
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & (smaller[before] != up)]
        out[c] = np.concatenate(waves) if waves else seeds[c][:0]
        scanned = np.concatenate([out[c], seeds[c]])
        before = scanned[scanned > 0] - 1
        first = text[before]
        go = (smaller[before] != up) & (first != c)
        _scatter(arrived, before[go], first[go])
    return out


def _induce(text, smaller, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the LMS positions in (bucket-wise) order."""
    order = np.argsort(text[lms], kind="stable")
    seeds = np.split(lms[order], np.searchsorted(text[lms][order], np.arange(1, size)))
    larger = _side(text, smaller, seeds, size, up=True)
    small = _side(text, smaller, [x[::-1] for x in larger], size, up=False)
    # no suffix follows the sentinel, so no pass brings it
    return np.concatenate([[len(text) - 1], *(x for c in range(size) for x in (larger[c], small[c][::-1]))])


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in order of the text: the ranks of their contents in ``order``."""
    mark = np.full(len(text), -1, np.int64)
    mark[lms] = np.arange(len(lms))
    found = mark[order]
    found = found[found >= 0]
    end = np.append(lms[1:] + 1, len(text))  # each up to and with the next LMS position
    own = chain_hash(text.astype(np.uint64), lms, end - lms)[found]
    names = np.empty(len(lms), np.int64)
    names[found] = np.append(0, np.cumsum(own[1:] != own[:-1]))
    return names


def _induced_order(names: np.ndarray) -> np.ndarray:
    """The suffixes of the reduced string in order, by induced sorting of its own leftmost-smaller
    substrings, and so on.  Its last name is less than all others.

    The reduced string has many letters and is short: here positions are moved one by one."""
    n = len(names)
    smaller = is_smaller(names)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    edge = np.append(0, np.cumsum(np.bincount(names))).tolist()
    letter = names.tolist()
    # of each position, the letter of the one before it if that is of the type that a pass brings, else -1
    before = np.append(np.append(-1, names[:-1]), -1)
    type_before = np.append(np.append(False, smaller[:-1]), False)
    larger, small = np.where(type_before, -1, before).tolist(), np.where(type_before, before, -1).tolist()

    def induced(seeds: list[int]) -> list[int]:
        order, tail = [-1] * n, edge[1:]
        for i in reversed(seeds):
            c = letter[i]
            tail[c] -= 1
            order[tail[c]] = i
        head = edge[:-1]
        for i in order:  # also what this loop puts further right
            c = larger[i]
            if c >= 0:
                order[head[c]] = i - 1
                head[c] += 1
        tail = edge[1:]
        for i in reversed(order):
            c = small[i]
            if c >= 0:
                tail[c] -= 1
                order[tail[c]] = i - 1
        return order

    if len(lms) > 1:
        own = _named(names, lms, np.array(induced(lms.tolist())))
        lms = lms[np.argsort(own) if own.max() == len(lms) - 1 else _order_of_names(own)]
    return np.array(induced(lms.tolist()))


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of the reduced string in order.  A name that stands once ends every comparison that reaches it, so of
    neighbours that all stand once the first is enough; the others are put between by their names."""
    once = np.bincount(names)[names] == 1
    drop = once & np.append(False, once[:-1])
    drop[-1] = False
    kept = np.flatnonzero(~drop)
    if len(kept) == len(names):
        return _induced_order(names)
    order = np.append(kept[_induced_order(np.unique(names[kept], return_inverse=True)[1])], np.flatnonzero(drop))
    return order[np.argsort(names[order], kind="stable")]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``text`` in order.  Its last value must be less than all others."""
    text = np.asarray(text)
    if len(text) < 3:
        return np.argsort(text, kind="stable")
    size = int(text.max()) + 1
    if size < 1 << 15:
        text = text.astype(np.int16)  # sorted by digits, and more of it fits in a cache
    smaller = is_smaller(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    if len(lms) > 1:
        names = _named(text, lms, _induce(text, smaller, lms, size))
        lms = lms[np.argsort(names) if names.max() == len(lms) - 1 else _order_of_names(names)]
    return _induce(text, smaller, lms, size)


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Permuted LCP of the bytes ``data``: of the suffix at each position with the one that precedes it
    in ``order``, up to ``limit`` (rounded up to eight bytes)."""
    n = len(order)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.append(data, np.zeros(limit + 16, np.uint8)).astype(np.uint64)
    eight = sum(padded[k : len(padded) - 7 + k] << np.uint64(8 * k) for k in range(8))
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(phi >= 0)
    other = phi[at]
    for k in range(0, limit, 8):
        differ = eight[at + k] ^ eight[other + k]
        end = differ != 0
        bits = differ[end] & (~differ[end] + np.uint64(1))  # the lowest bit that differs
        out[at[end]] = k + (np.log2(bits.astype(np.float64)).astype(np.int64) >> 3)
        at, other = at[~end], other[~end]
        if not len(at):
            break
    out[at] = limit
    return out


# -- segments -------------------------------------------------------------------------------------
def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _segments(batches, size: int):
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            n = len(flat)
            if n < size:
                continue
            sums = prefix(BYTE_CODE[flat])
            at = np.arange(n - ANCHOR + 1)
            name = span_hash(sums, at, at + ANCHOR)
            pick = (least(name & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), size - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - size + 1]
            begin = np.flatnonzero(np.arange(n - size + 1) + size <= offsets[1:][doc])
            first, m = repeats.runs(pick[begin], begin, doc[begin])
            begin = begin[first]
            if not len(begin):
                continue
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            end = begin + m - 1 + size
            yield from repeats.collapse(name[pick[begin]], byte_hash(flat, begin, end), span_hash(sums, begin, end), ids[doc[begin]], begin - offsets[doc[begin]], m, same_doc=True)


#: data: the bytes of a segment for a shard; null for a single window. later: a repeat already
SHARDED = "key bigint, check bigint, doc_id bigint, at bigint, later boolean, data binary"


def _cut(batches, size: int):
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            cand = part.column("cand")
            doc = np.repeat(np.arange(len(ids)), np.diff(cand.offsets.to_numpy()))
            anchor, at, hot = (cand.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "at", "hot"))
            start, n = at >> repeats.BITS, at & repeats.MASK
            fits = start + n - 1 + size <= np.diff(offsets)[doc]  # always, but for rows that share a doc_id
            cold = fits & ~hot
            begin = (start + offsets[doc])[cold]
            data = flat.tobytes()
            pieces = [data[b:e] for b, e in zip(begin.tolist(), (begin + n[cold] - 1 + size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([int64(anchor[cold]), int64(anchor[cold]), int64(ids[doc[cold]]), int64(at[cold]), pa.array(np.zeros(len(begin), bool)), pa.array(pieces, pa.binary())], repeats.columns(SHARDED))
            if (warm := fits & hot).any():
                m = n[warm]
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                s, d = np.repeat(start[warm], m) + step, np.repeat(doc[warm], m)
                begin = s + offsets[d]
                names = byte_hash(flat, begin, begin + size), span_hash(prefix(BYTE_CODE[flat]), begin, begin + size)
                key, check, owner, s, later = repeats.collapse_windows(*names, ids[d], s, same_doc=True)
                yield pa.RecordBatch.from_arrays([int64(key), int64(check), int64(owner), int64(s << repeats.BITS | 1), pa.array(later), pa.nulls(len(key), pa.binary())], repeats.columns(SHARDED))


def repeated_windows(doc: np.ndarray, at: np.ndarray, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of a shard, the windows that start earlier as well: document, start, number."""
    order = np.lexsort((at, doc))
    doc, start = doc[order], at[order] >> repeats.BITS
    n = np.array([len(p) for p in pieces], np.int64)[order]
    data = np.frombuffer(b"\0".join(pieces[i] for i in order.tolist()) + b"\0", np.uint8)
    edge = np.cumsum(n + 1) - 1
    text = np.append(data.astype(np.int16) + 2, 0).astype(np.int16)
    text[edge] = 1
    sa = suffix_array(text)
    equal = common_prefixes(data, sa[1:], size)[sa[1:]] >= size  # sa[0] is the sentinel
    group = np.cumsum(~equal)
    segment = np.repeat(np.arange(len(n)), n + 1)
    window = np.arange(len(data)) + size <= edge[segment]  # a window begins here
    first = np.full(group[-1] + 1, len(data))
    here = window[sa[1:]]
    np.minimum.at(first, group[here], sa[1:][here])  # the text is in order of (document, start)
    rank = np.empty(len(data), np.int64)
    rank[sa[1:]] = group
    pos = np.flatnonzero(window)
    where = segment[pos]
    offset = pos - (edge[where] - n[where])
    lead = first[rank[pos]]
    lw = segment[lead]
    same = (doc[lw] == doc[where]) & (start[lw] + lead - (edge[lw] - n[lw]) == start[where] + offset)
    later = ~same & (lead < pos)
    return repeats.joined(doc[where][later], (start[where] + offset)[later], np.ones(int(later.sum()), np.int64))


def _sorted_shards(batches, size: int, limit: int):
    schema = "doc_id bigint, at bigint"
    emit = lambda d, s: repeats.batch(schema, d, s << repeats.BITS | 1)
    held: list = []  # segments of whole anchors, and of the newest one
    done: list = []

    def shard():
        doc = np.concatenate([h[1] for h in held])
        at = np.concatenate([h[2] for h in held])
        d, s, n = repeated_windows(doc, at, [p for h in held for p in h[3]], size)
        return repeats.batch(schema, d, s << repeats.BITS | n)

    def singles():
        for b in batches:
            k, c, d, a, later = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            data = b.column(5)
            if later.any():
                done.append(repeats.batch(schema, d[later], a[later]))
            single = data.is_null().to_numpy(zero_copy_only=False) & ~later
            whole = np.flatnonzero(~single & ~later)
            if len(whole):
                pieces = data.take(pa.array(whole)).to_pylist()
                k2, d2, a2 = k[whole], d[whole], a[whole]
                cut = [0, *(np.flatnonzero(k2[1:] != k2[:-1]) + 1).tolist(), len(k2)]
                for lo, hi in zip(cut, cut[1:]):
                    if held and held[-1][0] != k2[lo] and sum(h[4] for h in held) >= limit:
                        done.append(shard())
                        held.clear()
                    held.append((k2[lo], d2[lo:hi], a2[lo:hi], pieces[lo:hi], sum(map(len, pieces[lo:hi]))))
            yield k[single], c[single], d[single], a[single] >> repeats.BITS

    for out in repeats.later_windows(singles(), True, emit):
        yield out
        while done:
            yield done.pop()
    if held:
        yield shard()
    while done:
        yield done.pop()


def _remove(batches, size: int, text: bool, carry: bool):
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            data = flat.tobytes()
            spans = part.column("spans")
            cut = spans.offsets.to_numpy()
            at = spans.values.to_numpy(zero_copy_only=False)
            known, there = part.column("doc_id").is_valid().to_pylist(), part.column("text").is_valid().to_pylist()
            rows = []
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                begin = end = at[:0]
                if cut[i + 1] > cut[i] and known[i]:
                    a = at[cut[i] : cut[i + 1]]
                    s = a >> repeats.BITS
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.minimum((s + (a & repeats.MASK) - 1 + size)[order], len(own))
                    reach = np.maximum.accumulate(e)
                    new = np.append(True, s[1:] > reach[:-1])
                    begin, end = s[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(own)]
                kept = b"".join(own[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)) if len(begin) else own
                rows.append((len(own), len(own) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if text and there[i] else None))
            n, removed, m, digest, kept = zip(*rows, strict=True)
            out = {"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(m, pa.int64()), "kept_sha256": pa.array(digest)}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(kept, pa.string())} if text else {}) | ({"carried": part.column("carried")} if carry else {}))


def remove_repeats(docs: DataFrame, size: int = 100, most: int = 4096, text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) without the bytes of ``size``-byte strings that also start earlier:
    counts and the hash of the kept bytes; with ``text`` also these as a string (kept_text, null for a
    null text; bytes of a character that was cut in two are left out); and the columns in ``carry`` as one struct
    (carried), so that their names can't clash."""
    schema = StructType.fromDDL(RESULT + ", kept_text string" * text)
    own = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    if carry:
        schema = schema.add("carried", own.schema["carried"].dataType)
    known = own.select("doc_id", "text").filter("doc_id is not null")
    segments = known.mapInArrow(partial(_segments, size=size), repeats.SEGMENT)
    judged = written(repeats.judge(segments, same_doc=True), "suffix")
    shards = known.join(repeats.candidates(judged, most), "doc_id").mapInArrow(partial(_cut, size=size), SHARDED)
    later = shards.repartition("key").sortWithinPartitions("key", "check", "doc_id", "at").mapInArrow(partial(_sorted_shards, size=size, limit=SHARD), "doc_id bigint, at bigint")
    return repeats.with_spans(own, [judged.filter("whole").select("doc_id", "at"), later], partial(_remove, size=size, text=text, carry=bool(carry)), schema)
