"""Quality rules by distribution divergence (operator 10).

Every document gets four plain counts and two Jensen-Shannon distances (base 2, 0 to 1): of its
character-class histogram and of its common-word histogram from the nearest language reference.
References come from all documents of the language: pass one counts every word of every row and takes each
language's ``most`` common ones (of equally common ones the first by their UTF-8 bytes), pass two sums both
histograms over the whole corpus; only these sums (a few hundred numbers for each language) reach the driver.
Pass three judges each document by itself, so no row is ever shuffled.  ``most`` belongs to the method: it is
the number of bins of the word histogram, whose last bin holds all other words.

Counts of words don't depend on how rows are batched: a task adds up what it has seen and gives it out by word.
Words, lines and windows are told apart by ``kernel.byte_hash``, lines by a second hash as well.

Defined results: a null or empty text has zero counts and fails the base rule; texts under
``min_words`` words or ``min_chars`` characters are too short to be judged by a histogram and only meet
the base rule; without any reference (no row has a language) the distances are 0; repeated rows are
judged one by one; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymesh.llm.frames import small_batches
from skymesh.llm.kernel import NOT_SPACE, Words, byte_hash, int64, mix, slices, span_hash, text_bytes

CLASSES = 8
#: words whose totals a task holds
HELD = 1 << 18
#: symbols 0, lower 1, upper 2, digit 3, space 4, punctuation 5, other ASCII 6, beyond ASCII 7; continuation bytes 8
CHAR_CLASS = np.full(256, 6, np.int64)
CHAR_CLASS[97:123], CHAR_CLASS[65:91], CHAR_CLASS[48:58] = 1, 2, 3
CHAR_CLASS[[9, 10, 11, 12, 13, 32]] = 4
CHAR_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
CHAR_CLASS[[ord(c) for c in "#*$%&|<>"]] = 0
CHAR_CLASS[192:] = 7
CHAR_CLASS[128:192] = CLASSES

JUDGED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ref_lang string, js_chars double, js_words double"


def _class_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(doc * (CLASSES + 1) + CHAR_CLASS[flat], minlength=(len(offsets) - 1) * (CLASSES + 1)).reshape(-1, CLASSES + 1)[:, :CLASSES]


def _word_counts(words: Words, common: np.ndarray) -> np.ndarray:
    """Of each document, the count of each common word and, last, of all others."""
    n, m = len(words.count), len(common)
    at = np.minimum(np.searchsorted(common, words.hash), max(0, m - 1))
    at = np.where(common[at] == words.hash, at, m) if m else np.zeros(len(words.hash), np.int64)
    return np.bincount(words.doc * (m + 1) + at, minlength=n * (m + 1)).reshape(n, m + 1)


def _lower(flat: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(flat, offsets, NOT_SPACE, lower=True)


def _word_totals(batches):
    """(lang, word, n) of all words, added up in the task; totals go out whenever more than ``HELD`` words are held."""
    held: dict[tuple, list] = {}  # (lang, hash): word, count

    def out():
        key = list(held)
        while key:
            part, size = [], 0
            while key and size < 1 << 20:
                part.append(key.pop())
                size += len(held[part[-1]][0]) + 16
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([held[k][0] for k in part], pa.binary()).cast(pa.string()), pa.array([held[k][1] for k in part], pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch):
            words = _lower(*text_bytes(part.column("text")))
            langs = np.array(part.column("lang").to_pylist(), object)
            data = memoryview(np.ascontiguousarray(words.flat))
            for lang in {x for x in langs if x is not None}:
                there = np.flatnonzero((langs == lang)[words.doc])
                own, place, n = np.unique(words.hash[there], return_index=True, return_counts=True)
                for h, i, c in zip(own.tolist(), there[place].tolist(), n.tolist(), strict=True):
                    if (lang, h) in held:
                        held[lang, h][1] += c
                    else:
                        held[lang, h] = [bytes(data[words.start[i] : words.end[i]]), c]
            if len(held) > HELD:
                yield from out()
    yield from out()


def _sums(batches, common: np.ndarray):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            counts = np.hstack([_class_counts(flat, offsets), _word_counts(_lower(flat, offsets), common)])
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in {x for x in langs if x is not None}:
                total[lang] = total.get(lang, 0) + counts[langs == lang].sum(0)
    for lang, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(np.arange(len(v), dtype=np.int32)), int64(v)], ["lang", "bin", "n"])


def references(docs: DataFrame, most: int = 64) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The common words (sorted hashes) and each language's two histograms, over all rows of (text, lang)."""
    counted = docs.mapInArrow(_word_totals, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("place", place).filter(F.col("place") <= most).select("word").distinct()
    found = b" ".join(r.word.encode() for r in top.collect())
    common = np.unique(_lower(np.frombuffer(found, np.uint8), np.array([0, len(found)])).hash)
    rows = docs.mapInArrow(partial(_sums, common=common), "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    found: dict[str, np.ndarray] = {}
    for lang, at, n in rows:
        found.setdefault(lang, np.zeros(CLASSES + len(common) + 1))[at] = n
    return common, dict(sorted(found.items()))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the counts ``q``; 0 for rows without counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0.0)


def _counts(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(offsets) - 1
    words = Words(flat, offsets, NOT_SPACE, lower=False)
    n_words = words.count
    inside = np.zeros(len(flat) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    lead = np.concatenate([[0], np.cumsum((np.cumsum(inside[:-1]) > 0) & ((flat & 0xC0) != 0x80))])
    # lines: a document's start and every newline begin one
    begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(flat == 10) + 1]))
    begin = begin[begin < len(flat)]
    end = np.append(begin[1:], len(flat))[: len(begin)]
    end = end - (flat[end - 1] == 10) if len(end) else end
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[has], end[has]
    doc = np.searchsorted(offsets, begin, "right") - 1
    line, check = byte_hash(flat, begin, end), span_hash(words.sums, begin, end)
    order = np.lexsort((check, line, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1]) & (check[order][1:] == check[order][:-1])
    first = order[np.append(True, ~same)] if len(order) else order
    dup = np.bincount(doc, minlength=docs) - np.bincount(doc[first], minlength=docs)
    # words inside a window of five that the same document has again
    at, five = words.windows(5)
    _, inverse, n = np.unique(five ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    again = at[n[inverse] > 1]
    edge = np.zeros(len(words.start) + 6, np.int64)
    edge[again] += 1
    np.subtract.at(edge, again + 5, 1)
    covered = np.cumsum(edge)[: len(words.start)] > 0
    return {"n_words": n_words, "word_chars": lead[offsets[1:]] - lead[offsets[:-1]], "n_dup_lines": dup, "n_repeat_words": np.bincount(words.doc[covered], minlength=docs)}


def _judge(batches, common, refs, max_chars, max_words, min_words, min_chars):
    names = list(refs)
    for batch in batches:
        for part in slices(batch):
            flat, offsets = text_bytes(part.column("text"))
            classes = _class_counts(flat, offsets)
            got = _counts(flat, offsets)
            docs = len(offsets) - 1
            js_c, js_w, best = np.zeros(docs), np.zeros(docs), np.full(docs, -1)
            if names:
                hist = _word_counts(_lower(flat, offsets), common)
                c = np.array([js_distance(classes, refs[x][:CLASSES]) for x in names])
                w = np.array([js_distance(hist, refs[x][CLASSES:]) for x in names])
                best = np.argmin(c + w, 0)
                js_c, js_w = c[best, np.arange(docs)], w[best, np.arange(docs)]
            n = got["n_words"]
            failed = (n < 10) | (100 * got["n_repeat_words"] > 20 * n)
            short = (n < min_words) | (classes.sum(1) < min_chars)
            kept = ~failed & (short | ((js_c <= max_chars) & (js_w <= max_words)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(int64(x) for x in (n, got["word_chars"], classes[:, 0], got["n_dup_lines"], got["n_repeat_words"])), pa.array(failed), pa.array(kept), pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array(js_c), pa.array(js_w)],
                [x.split()[0] for x in JUDGED.split(", ")],
            )


def quality(docs: DataFrame, max_chars: float = 0.28, max_words: float = 0.5, min_words: int = 50, min_chars: int = 200) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): counts, distances and verdict."""
    own = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    common, refs = references(own.select("text", "lang"))
    judge = partial(_judge, common=common, refs=refs, max_chars=max_chars, max_words=max_words, min_words=min_words, min_chars=min_chars)
    return own.select("doc_id", "text").mapInArrow(judge, JUDGED)
