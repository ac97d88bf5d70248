"""Language identification of code-switched text by a linear-chain conditional random field (operator 8).

Words are runs of letters.  A word's features are its first one to three and last one to four bytes, all
byte pairs and triples inside it, and itself if the training sample has it at least three times (the
lexicon); they index hashed weights for each language.  Learned transitions join neighbouring words, and
forward-backward gives each word's probability of each language.  A document gets the language with the
greatest mean over its words, and that mean as score; ``spans`` are its runs of words with one most likely
language (first word, number of words, language), so code-switched text shows its switches.

Labelled documents are of one language each.  So that transitions meet switches as well, part of the training
text is dealt anew: chunks of ``chunk`` words, taken from all languages in random order, four to a document.

Texts of any length are labelled exactly and without a long loop: a document is cut into pieces, the
transfer matrices of all pieces are multiplied side by side, the messages at the cuts follow from them,
and then all pieces run forward and backward at once.

Only rows with a language whose ``crc32(doc_id as text) % 4`` isn't 2 are learned from, at most
``per_language`` of each language (those with the least hash, in one pass), trained on the driver; the model (hashed
weights of a fixed size for each language) goes to all tasks and documents are never exchanged.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text if
nothing can be learned; repeated rows are labelled one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymesh.llm.frames import texts, written
from skymesh.llm.kernel import _BASE, BYTE_CODE, Words, powers, prefix, slices, text_bytes

BITS = 15
PIECE = 128
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
LABELLED = "doc_id bigint, lang_pred string, score double, spans array<struct<first: bigint, words: bigint, lang: string>>"


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, one place of each, and which one each word is."""
    return np.unique(words.hash, return_index=True, return_inverse=True)


def features(words: Words, name: np.ndarray, place: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) of the distinct words ``name``, found at ``place``."""
    start, end = words.start[place], words.end[place]
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data = words.flat[np.repeat(start, size) + at]
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(name)), size)
    sums, step = prefix(BYTE_CODE[data]), powers(_BASE, len(data) + 1)

    def bucket(lo, hi, kind):
        raw = (sums[hi] - sums[lo]) * step[lo] + np.uint64(kind * 0x9E6C63D0676A9A99 & (1 << 64) - 1)
        return ((raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    who, what = [], []
    everyone = np.arange(len(name))
    for n in (1, 2, 3):
        who.append(everyone)
        what.append(bucket(first, first + np.minimum(n, size), n))
    for n in (1, 2, 3, 4):
        who.append(everyone)
        what.append(bucket(first + np.maximum(size - n, 0), first + size, 10 + n))
    for n in (2, 3):
        fits = np.flatnonzero(at + n <= np.repeat(size, size))
        who.append(owner[fits])
        what.append(bucket(fits, fits + n, 20 + n))
    if len(lexicon):
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, name), len(lexicon) - 1)] == name)
        who.append(known)
        what.append(bucket(first[known], first[known] + size[known], 30))
    return np.concatenate(who), np.concatenate(what)


def emissions(who: np.ndarray, what: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Of each distinct word, the sum of its features' weights for each label."""
    return np.stack([np.bincount(who, weights=w[what], minlength=n) for w in weights], 1)


def marginals(score: np.ndarray, count: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of all words, given their scores (words of one document after the
    other, ``count`` each), and the expected number of each transition."""
    labels = score.shape[1]
    pieces = -(-count // PIECE)
    doc = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(count[doc] - nth * PIECE, PIECE)
    begin = (np.cumsum(count) - count)[doc] + nth * PIECE
    order = np.argsort(-length, kind="stable")  # the pieces that reach step t stand first
    many = np.searchsorted(-length[order], -np.arange(PIECE), "left")  # with length > t
    t_mat = np.exp(transition - transition.max())
    step = np.arange(PIECE)[:, None]
    at = begin[order] + step
    emit = np.exp(score - score.max(1, keepdims=True))[np.minimum(at, len(score) - 1)]  # step, piece, label
    p = len(order)
    carry = np.broadcast_to(np.eye(labels), (p, labels, labels)).copy()
    for t in range(PIECE):
        m = many[t]
        if not m:
            break
        carry[:m] = (carry[:m] @ t_mat) * emit[t, :m, None, :]
        carry[:m] /= carry[:m].max((1, 2), keepdims=True)
    # messages at the cuts, piece by piece of all documents at once
    ahead, behind = np.full((p, labels), 1 / labels), np.ones((p, labels))
    where = np.empty(p, np.int64)
    where[order] = np.arange(p)
    head = np.cumsum(pieces) - pieces
    for j in range(1, int(pieces.max(initial=0))):
        has = head[pieces > j]
        a, b = where[has + j - 1], where[has + j]
        v = np.einsum("pi,pij->pj", ahead[a], carry[a])
        ahead[b] = v / v.sum(1, keepdims=True)
    for j in range(int(pieces.max(initial=0)) - 1, 0, -1):
        has = head[pieces > j]
        a, b = where[has + j - 1], where[has + j]
        v = np.einsum("pij,pj->pi", carry[b], behind[b])
        behind[a] = v / v.max(1, keepdims=True)
    forward = np.zeros((PIECE, p, labels))
    f = ahead.copy()
    prior = np.zeros((PIECE, p, labels))
    for t in range(PIECE):
        m = many[t]
        if not m:
            break
        prior[t, :m] = f[:m]
        v = (f[:m] @ t_mat) * emit[t, :m]
        f[:m] = v / v.sum(1, keepdims=True)
        forward[t, :m] = f[:m]
    expected = np.zeros((labels, labels))
    b = behind.copy()
    for t in range(PIECE - 1, -1, -1):
        m = many[t]
        if not m:
            continue
        right = emit[t, :m] * b[:m]
        v = forward[t, :m] * b[:m]
        joint = prior[t, :m, :, None] * t_mat * right[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        forward[t, :m] = v / v.sum(1, keepdims=True)
        v = right @ t_mat.T
        b[:m] = v / v.max(1, keepdims=True)
    out = np.empty_like(score)
    inside = step < length[order]
    out[at[inside]] = forward[inside]
    return out, expected


@dataclass
class Field:
    langs: list[str]
    lexicon: np.ndarray
    weights: np.ndarray  # label x feature
    transition: np.ndarray


def _words(column: pa.Array) -> Words:
    return Words(*text_bytes(column), LETTER, lower=True)


def switched(words: Words, share: float, chunk: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, and their numbers by document, of texts that change language every ``chunk`` words."""
    inside = np.arange(len(words.start)) - words.first[words.doc]
    begin = np.flatnonzero(inside % chunk == 0)
    size = np.minimum(begin + chunk, words.first[words.doc[begin] + 1]) - begin
    rng = np.random.default_rng(seed)
    pick = rng.permutation(len(begin))[: int(len(begin) * share)]
    begin, size = begin[pick], size[pick]
    place = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return place, np.add.reduceat(size, np.arange(0, len(size), 4)) if len(size) else size


def fit(rows: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15, ridge: float = 1e-6, share: float = 0.25, chunk: int = 12) -> Field | None:
    """The field that best explains texts of known languages (text, lang), by Adam steps.  ``share`` of the words are
    also learned in switched texts."""
    langs = sorted({lang for _, lang in rows})
    words = _words(pa.array([text for text, _ in rows], pa.string()))
    if not len(words.start):
        return None
    name, place, which = distinct_words(words)
    lexicon = name[np.bincount(which) >= 3]
    who, what = features(words, name, place, lexicon)
    label = np.searchsorted(langs, np.array([lang for _, lang in rows]))[words.doc]
    k = len(langs)
    mixed, sizes = switched(words, share if k > 1 else 0.0, chunk)
    which, label, count = np.concatenate([which, which[mixed]]), np.concatenate([label, label[mixed]]), np.concatenate([words.count, sizes])
    n, doc = len(label), np.repeat(np.arange(len(count)), count)
    seen = np.stack([np.bincount(which, weights=label == j, minlength=len(name)) for j in range(k)], 1)
    joint = np.zeros((k, k))
    follows = doc[1:] == doc[:-1]
    np.add.at(joint, (label[:-1][follows], label[1:][follows]), 1)
    np.add.at(joint, (slice(None), label[(np.cumsum(count) - count)[count > 0]]), 1 / k)
    w, t = np.zeros((k, 1 << BITS)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for i in range(1, rounds + 1):
        p, expected = marginals(emissions(who, what, len(name), w)[which], count, t)
        rest = seen - np.stack([np.bincount(which, weights=p[:, j], minlength=len(name)) for j in range(k)], 1)
        gw = np.stack([np.bincount(what, weights=rest[who, j], minlength=1 << BITS) for j in range(k)]) / n - ridge * w
        gt = (joint - expected) / n - ridge * t
        for value, g, a in ((w, gw, 0), (t, gt, 2)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[a + 1] = 0.99 * state[a + 1] + 0.01 * g * g
            value += rate * (state[a] / (1 - 0.9**i)) / (np.sqrt(state[a + 1] / (1 - 0.99**i)) + 1e-9)
    return Field(langs, lexicon, w.astype(np.float32), t)


def _labelled(batches, field: Field | None):
    for batch in batches:
        for part in slices(batch):
            n = part.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            first, many, label, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            words = _words(part.column("text"))
            if field and len(words.start):
                name, place, which = distinct_words(words)
                who, what = features(words, name, place, field.lexicon)
                p, _ = marginals(emissions(who, what, len(name), field.weights)[which], words.count, field.transition)
                share = np.stack([np.bincount(words.doc, weights=p[:, j], minlength=n) for j in range(p.shape[1])], 1) / np.maximum(words.count, 1)[:, None]
                best = share.argmax(1)
                ascii_letter = np.bincount(words.doc, weights=words.flat[words.start] < 0x80, minlength=n) > 0
                label = p.argmax(1)
                new = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])))
                many, label, first = np.diff(np.append(new, len(p))), label[new], new - words.first[words.doc[new]]
                cut = np.searchsorted(words.doc[new], np.arange(n + 1))
                for i in np.flatnonzero(words.count).tolist():
                    if ascii_letter[i] or any(map(str.isalpha, part.column("text")[i].as_py())):
                        lang[i], score[i] = field.langs[best[i]], min(1.0, share[i, best[i]])
            names = pa.array(field.langs if field else [], pa.string()).take(pa.array(label))
            spans = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(first), pa.array(many), names], ["first", "words", "lang"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])


def learn(docs: DataFrame, per_language: int = 200) -> Field | None:
    """The field from at most ``per_language`` documents of each language."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    keys = ["doc_id", "lang", "key"]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.filter("doc_id is not null and lang is not null").filter(crc % 4 != 2).withColumn("key", F.xxhash64("text"))
    # rows of one doc_id are told apart by language and text; equal rows are one
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "key"))
    chosen = own.select(*keys).distinct().withColumn("place", place).filter(F.col("place") <= per_language).drop("place")
    sample = own.join(F.broadcast(chosen), keys).filter("text is not null").groupBy(*keys).agg(F.min("text").alias("text"))
    sample = written(sample, "language-sample")
    rows = [(r.text, r.lang) for r in sample.orderBy("doc_id", "text", "lang").collect()]
    return fit(rows) if rows else None


def languages(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): language and score."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return texts(docs).mapInArrow(partial(_labelled, field=field), LABELLED).select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")
