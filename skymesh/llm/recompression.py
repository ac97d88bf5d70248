"""Substring dedup by recompression (operator 3).

Words become 64-bit names.  In each round a document's sequence of names is compressed by naming
neighbouring pairs: a bit of each name's hash puts it on the left or right side, and every left name
that stands before a right name forms a pair with it.  A pair's name is the hash of both names, so it is
the same in every document and every task without any exchange.  Equal neighbours (runs) are on the
same side and never pair; runs thus stay whole sequences of one name, wherever they are cut.  Whether
two neighbours join depends on these two names alone: after r rounds (symbols of up to 2^r words) all
symbols inside a window, but for 2^r - 1 words at either edge, are the same in every occurrence of the
window.  One more level names every phrase of three symbols.  The anchor of a window is the phrase inside
it whose name has the least hash.  One round leaves 11 of 13 words, room enough
for a phrase in every window (two rounds leave 7, and anchors of one symbol, of which half are shared by
unrelated texts).

Symbols shared between documents reveal the long repeats and exact window names verify them; the steps
are those of :mod:`skymesh.llm.repeats`.

Defined results: a null text has no words (0, 0 and the hash of the empty string), as has an empty one;
documents under 13 words lose nothing; rows without doc_id take no part in comparisons and keep all
words; rows that share a doc_id are the same document (removed spans hold for each of them); windows
repeated only inside one document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.llm import repeats
from skymesh.llm.frames import texts, written
from skymesh.llm.kernel import NOT_SPACE, Words, chain_hash, mix, slices, span_hash, text_bytes

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def compress(name: np.ndarray, begin: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: names, first words and documents of the sequence in which pairs have become one."""
    salt = np.uint64(0xA24BAED4963EE407 * (2 * level + 1) & (1 << 64) - 1)
    left = (mix(name + salt) & np.uint64(1)) == 0
    second = np.zeros(len(name), bool)  # of a pair
    second[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~second)
    out = name[first].copy()
    pair = np.flatnonzero(second) - 1
    out[np.searchsorted(first, pair)] = mix(mix(name[pair] + salt) * np.uint64(3) + name[pair + 1])
    return out, begin[first], doc[first]


def anchors(words: Words, size: int, at: np.ndarray, rounds: int = 1, span: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The phrase of ``span`` symbols that anchors each window ``at``, and the names of all phrases."""
    name, begin, doc = words.hash, np.arange(len(words.start)), words.doc
    for level in range(rounds):
        name, begin, doc = compress(name, begin, doc, level)
    end = np.append(begin[1:], len(words.start))
    lost = (1 << rounds) - 1  # words at either edge whose symbols may depend on what stands outside
    many = len(name) - span + 1
    phrase, last = name[:many].copy(), end[span - 1 :]
    for k in range(1, span):
        phrase = mix(phrase * np.uint64(5) + name[k : many + k])
    order = mix(phrase)
    low = np.searchsorted(begin, at + lost)
    high = np.searchsorted(last, at + size - lost, "right")
    pick, best = low.copy(), order[low]
    for k in range(1, size - 2 * lost):
        more = low + k < high
        if not more.any():
            break
        there = np.where(more, low + k, low)
        less = more & (order[there] < best)
        pick[less], best[less] = there[less], order[there][less]
    return pick, phrase


def _segments(batches, size: int):
    for batch in batches:
        for part in slices(batch):
            words = Words(*text_bytes(part.column("text")), NOT_SPACE, lower=False)
            at = words.starts(size)
            if not len(at):
                continue
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            pick, names = anchors(words, size, at)
            first, n = repeats.runs(pick, at, words.doc[at])
            begin = at[first]
            name = chain_hash(words.hash, begin, n - 1 + size)
            check = span_hash(words.sequence, begin, begin + n - 1 + size)
            doc = words.doc[begin]
            yield from repeats.collapse(names[pick[first]], name, check, ids[doc], begin - words.first[doc], n, same_doc=False)


PLACED = "key bigint, check bigint, doc_id bigint, at bigint, later boolean"


def _windows(batches, size: int):
    """All windows of each document's candidate segments."""
    for batch in batches:
        for part in slices(batch):
            words = Words(*text_bytes(part.column("text")), NOT_SPACE, lower=False)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            cand = part.column("cand")
            count = np.diff(cand.offsets.to_numpy())
            at = cand.flatten().field("at").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), count)
            start, n = at >> repeats.BITS, at & repeats.MASK
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, doc = np.repeat(start, n) + step, np.repeat(doc, n)
            begin = start + words.first[doc]
            fits = begin + size <= words.first[doc + 1]  # always, but for rows that share a doc_id
            begin, start, doc = begin[fits], start[fits], doc[fits]
            key, check, owner, start, later = repeats.collapse_windows(chain_hash(words.hash, begin, size), span_hash(words.sequence, begin, begin + size), ids[doc], start, same_doc=False)
            # of one document, equal windows that touch go on as one row
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (owner[1:] != owner[:-1])
            row, begin, n = repeats.touching(np.cumsum(new), start, np.ones(len(key), np.int64))
            yield repeats.batch(PLACED, key[row], check[row], owner[row], begin << repeats.BITS | n, later[row])


def _later(batches):
    def parts():
        for b in batches:
            k, c, d, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            w = b.column(4).to_numpy(zero_copy_only=False)
            done.append((d[w], s[w]))
            yield k[~w], c[~w], d[~w], s[~w]

    done: list = []
    emit = lambda d, at: repeats.batch("doc_id bigint, at bigint", d, at)
    for out in repeats.later_windows(parts(), False, emit):
        yield out
        while done:
            yield emit(*done.pop())
    while done:
        yield emit(*done.pop())


def _remove(batches, size: int, text: bool):
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            data = flat.tobytes()
            spans = part.column("spans").to_pylist()
            known = part.column("doc_id").is_valid().to_pylist()
            rows = []
            for i in range(part.num_rows):
                words = data[offsets[i] : offsets[i + 1]].split()
                n = len(words)
                if spans[i] and known[i]:
                    at = np.array(spans[i], np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(at >> repeats.BITS, n), 1)
                    np.add.at(edge, np.minimum((at >> repeats.BITS) + (at & repeats.MASK) - 1 + size, n), -1)
                    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[j] for j in keep.tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if text else b""))
            n, removed, digest, kept = zip(*rows, strict=True)
            out = {"doc_id": part.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest)}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if text else {}))


def remove_repeats(docs: DataFrame, size: int = 13, text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) without the words of ``size``-word windows that also start in a
    document with a smaller doc_id: counts and the hash of the kept words joined by a space;
    with ``text`` also these (kept_text)."""
    own = texts(docs)
    known = own.filter("doc_id is not null")
    segments = known.mapInArrow(partial(_segments, size=size), repeats.SEGMENT)
    judged = written(repeats.judge(segments, same_doc=False), "recompression")
    cand = judged.filter("not whole").groupBy("doc_id").agg(F.collect_list(F.struct("at")).alias("cand"))
    windows = known.join(cand, "doc_id").mapInArrow(partial(_windows, size=size), PLACED)
    later = windows.repartition("key").sortWithinPartitions("key", "check", "doc_id", "at").mapInArrow(_later, "doc_id bigint, at bigint")
    return repeats.with_spans(own, [judged.filter("whole").select("doc_id", "at"), later], partial(_remove, size=size, text=text), RESULT + ", kept_text string" * text)
