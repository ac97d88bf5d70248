"""Toxicity by the nearest labelled examples (operator 1).

Terms are byte n-grams inside words (with the word's edges) and whole words, lower-cased.  From a bounded
sample of labelled documents the terms that point to the toxic label are selected by chi-square, and the
sample becomes an index of TF-IDF vectors over these terms: postings in order of the example, in blocks of
``BLOCK`` examples, each with the greatest weight that a term has in it.  A document's nearest examples by
cosine are found exactly: blocks are visited in order of their upper bound until it falls below the
k-th best.  Votes weighted by similarity and the strength of the document's own evidence give a score,
calibrated by a logistic fit to leave-one-out votes of the sample, weighted back to all labels.

Only rows with a label whose ``crc32(doc_id as text) % 3`` isn't 1 are learned from.  The sample's bounds
(``toxic``, ``other``) limit the model, which is all that is sent to tasks; every document is scored in
place, without an exchange.

Defined results: null and empty texts, and texts without any selected term, get the rate of toxic labels
among examples without such terms; without usable labels every score is 0; several labels of one
document count as toxic if any is; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.llm.frames import filtered_in_place, texts, written
from skymesh.llm.kernel import BYTE_CODE, LOWER, powers, prefix, slices, text_bytes, _BASE

GRAMS = (4, 5, 6, 7)
BUCKETS = 22  # bits
BLOCK = 64
WORD = np.zeros(256, bool)
WORD[0x61:0x7B] = WORD[0x30:0x3A] = WORD[0x80:] = True
SCORED = "doc_id bigint, score double, predicted int, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>"


def terms(part: pa.RecordBatch, select: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every occurrence of a term; only of those that ``select`` marks, if given."""
    flat, offsets = text_bytes(part.column("text"))
    doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    text = np.full(len(flat) + part.num_rows + 1, 0x20, np.uint8)  # documents don't touch
    low = LOWER[flat]
    text[np.arange(len(flat)) + doc + 1] = np.where(WORD[low], low, 0x20)
    inside = text != 0x20
    sums = prefix(BYTE_CODE[text])
    step = powers(_BASE, len(text))
    outside = np.concatenate([[0], np.cumsum(~inside)])
    begin = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    where, found = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        at = np.arange(len(text) - n + 1)
        name = (sums[n:] - sums[:-n]) * step[: len(at)] + np.uint64(n * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        bucket = (name >> np.uint64(64 - BUCKETS)).astype(np.int64)
        good = outside[n - 1 :][: len(at)] == outside[1:][: len(at)]  # but for its ends, all of it is one word
        if select is not None:
            good &= select[bucket]
        where.append(at[good] + n // 2)
        found.append(bucket[good])
    name = (sums[end] - sums[begin]) * step[begin] + np.uint64(0x8CB92BA72F3D8DD7)
    bucket = (name >> np.uint64(64 - BUCKETS)).astype(np.int64)
    good = select[bucket] if select is not None else np.ones(len(bucket), bool)
    where.append(begin[good])
    found.append(bucket[good])
    edge = offsets[:-1] + np.arange(part.num_rows)  # of each document, the byte before it
    return np.searchsorted(edge, np.concatenate(where), "right") - 1, np.concatenate(found)


def _frequencies(batches):
    for batch in batches:
        for part in slices(batch):
            doc, bucket = terms(part)
            one = np.unique(doc << BUCKETS | bucket)
            doc, bucket = one >> BUCKETS, one & (1 << BUCKETS) - 1
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc]
            own, at = np.unique(bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, minlength=len(own))), pa.array(np.bincount(at, weights=toxic, minlength=len(own)).astype(np.int64))], ["term", "n", "p"])


@dataclass
class Model:
    term: np.ndarray  # sorted buckets
    idf: np.ndarray
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    post_cut: np.ndarray  # term x block: where its postings (examples and weights) begin
    post_at: np.ndarray
    post_weight: np.ndarray
    block_max: np.ndarray  # term x block
    fit: np.ndarray  # of the logistic calibration
    none: float  # the score without evidence
    k: int

    def vectors(self, part: pa.RecordBatch, select: np.ndarray):
        """(document, terms, weights, strength) of each document that has a selected term."""
        doc, bucket = terms(part, select)
        if not len(doc):
            return
        one, n = np.unique(doc << BUCKETS | bucket, return_counts=True)
        doc, at = one >> BUCKETS, np.searchsorted(self.term, one & (1 << BUCKETS) - 1)
        weight = (1 + np.log(n)) * self.idf[at]
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(doc)).tolist(), strict=True):
            size = float(np.sqrt((weight[lo:hi] ** 2).sum()))
            yield int(doc[lo]), at[lo:hi], weight[lo:hi] / size, size

    def nearest(self, at: np.ndarray, weight: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, by (cosine, id): exact, by block upper bounds."""
        bound = weight @ self.block_max[at]
        order = np.argsort(-bound, kind="stable")
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        floor = 0.0
        for block in order.tolist():
            if bound[block] <= 0 or (len(best) == self.k and bound[block] + 1e-12 < floor):
                break
            lo, hi = block * BLOCK, (block + 1) * BLOCK
            got = np.zeros(BLOCK)
            cut = self.post_cut[at, block : block + 2]
            for (b, e), w in zip(cut.tolist(), weight.tolist(), strict=True):
                if e > b:
                    got[self.post_at[b:e] - lo] += w * self.post_weight[b:e]
            if lo <= leave < hi:
                got[leave - lo] = 0
            new = np.flatnonzero(got)
            best_at, best = np.concatenate([best_at, new + lo]), np.concatenate([best, got[new]])
            top = np.lexsort((best_at, -best))[: self.k]
            best_at, best = best_at[top], best[top]
            floor = best[-1] if len(best) else 0.0
        return best_at, best

    def features(self, near: np.ndarray, cosine: np.ndarray, strength: float) -> list[float]:
        vote = (cosine * self.toxic[near]).sum() / cosine.sum() if len(near) else 0.0
        return [1.0, vote, np.log1p(strength), float(cosine[0]) if len(near) else 0.0]

    def score(self, near, cosine, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(near, cosine, strength) @ self.fit, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, toxic: int = 2000, other: int = 4000, least_chi2: float = 40.0, least_share: float = 0.8, k: int = 15) -> Model | None:
    """The model from a sample of at most ``toxic`` and ``other`` labelled documents.  A term is selected
    if its chi-square is at least ``least_chi2`` and ``least_share`` of its documents are toxic, where
    both labels count alike: as many as pass, which the sample's size bounds."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(crc % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(41)), "doc_id").limit(n) for y, n in ((1, toxic), (0, other))]
    sample = texts(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").filter("length(text) > 0")
    # equal texts are one example, toxic if any of them is, whichever rows come first
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    sample = written(sample, "toxic-sample")  # at most toxic + other rows
    count = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return None
    total = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, rate = sum(count.values()), count.get(1, 0) / sum(count.values())
    seen = sample.select("text", "toxic").mapInArrow(_frequencies, "term bigint, n bigint, p bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    n, p, e = F.col("n"), F.col("p"), F.col("n") * F.lit(rate)
    # labels of one kind select nothing: every document gets their constant rate
    chi2 = F.try_divide(F.pow(p - e, F.lit(2)), e * F.lit(max(1e-9, 1 - rate)) * F.greatest(F.lit(1e-9), (1 - n / F.lit(rows + 1.0))))
    picked = seen.filter((n >= 4) & (p * F.lit(1 - rate) >= least_share * (p * F.lit(1 - rate) + (n - p) * F.lit(rate)))).withColumn("chi2", chi2).filter(F.col("chi2") >= least_chi2).collect()
    picked.sort(key=lambda r: r.term)
    term = np.array([r.term for r in picked], np.int64)
    idf = np.log(rows / np.array([r.n for r in picked], float)) + 1
    model = Model(term, idf, np.zeros(0, np.int64), np.zeros(0), np.zeros((len(term), 2), np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(term), 0)), np.zeros(4), 0.0, k)
    vectors = sample.select("doc_id", "text", "toxic").mapInArrow(partial(_vectors, model=model), "doc_id bigint, toxic int, terms array<bigint>, weights array<double>, strength double").orderBy("doc_id").collect()
    # examples with the same strongest term stand together: their blocks have distinct upper bounds
    own = sorted((r for r in vectors if r.terms), key=lambda r: (r.terms[int(np.argmax(r.weights))], r.doc_id))
    per = {y: total.get(y, 0) / count[y] for y in count}
    bare = [per[r.toxic] * np.array([1, r.toxic]) for r in vectors if not r.terms]
    model.none = float(np.sum(bare, 0)[1] / np.sum(bare, 0)[0]) if bare else 0.0
    if not own:
        return model
    at = np.concatenate([r.terms for r in own])
    example = np.repeat(np.arange(len(own)), [len(r.terms) for r in own])
    weight = np.concatenate([r.weights for r in own])
    order = np.lexsort((example, at))
    model.ids, model.toxic = np.array([r.doc_id for r in own], np.int64), np.array([r.toxic for r in own], float)
    model.post_at, model.post_weight = example[order], weight[order]
    blocks = len(own) // BLOCK + 1
    model.post_cut = np.searchsorted((at * blocks + example // BLOCK)[order], np.arange(len(term))[:, None] * blocks + np.arange(blocks + 1))
    model.block_max = np.zeros((len(term), blocks))
    np.maximum.at(model.block_max, (at, example // BLOCK), weight)
    x = np.array([model.features(*model.nearest(np.array(r.terms), np.array(r.weights), leave=i), r.strength) for i, r in enumerate(own)])
    y = model.toxic
    share = np.array([per[int(v)] for v in y])
    w = np.zeros(4)
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (share * (y - q)) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.fit = w
    return model


def _mark(model: Model) -> np.ndarray:
    select = np.zeros(1 << BUCKETS, bool)
    select[model.term] = True
    return select


def _vectors(batches, model: Model):
    select = _mark(model)
    for batch in batches:
        for part in slices(batch):
            got: list = [([], [], 0.0)] * part.num_rows
            for i, at, weight, size in model.vectors(part, select):
                got[i] = (at.tolist(), weight.tolist(), size)
            t, w, s = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(t, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.float64())), pa.array(s, pa.float64())], ["doc_id", "toxic", "terms", "weights", "strength"])


def _scored(batches, model: Model | None, least: float, show: int):
    select = _mark(model) if model else None
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    for batch in batches:
        for part in slices(batch):
            score = np.full(part.num_rows, model.none if model else 0.0)
            why: list = [[] for _ in range(part.num_rows)]
            if model and len(model.ids):
                for i, at, weight, size in model.vectors(part, select):
                    near, cosine = model.nearest(at, weight)
                    score[i] = model.score(near, cosine, size)
                    why[i] = [{"doc_id": int(model.ids[j]), "similarity": float(c), "toxic": int(model.toxic[j])} for j, c in zip(near[:show], cosine[:show], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= least).astype(np.int32)), pa.array(why, kind)], ["doc_id", "score", "predicted", "evidence"])


def acceptable(docs: DataFrame, model: Model | None, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under ``least``, filtered in place."""
    return filtered_in_place(docs, partial(_scored, model=model, least=least, show=0), "predicted")


def score(docs: DataFrame, model: Model | None, least: float = 0.7, show: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): score, prediction and the nearest examples."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = texts(docs).mapInArrow(partial(_scored, model=model, least=least, show=show), SCORED)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
