"""Spelling variants: words one edit apart, by an index of variable-length grams (operator 11).

Words are runs of letters, some with one letter left out (``words``).  Two are near if one inserted, deleted or
replaced code point makes them equal.  Near words are found by grams of variable length:

* ``dictionary``: how many words have a gram of 2 to ``LONGEST`` code points, pruned to the frequent ones: more than
  ``many`` occurrences, where ``many`` grows with the words so that at most ``ENTRIES`` grams are kept.
* ``decomposed``: at each place of a word the shortest gram that isn't frequent, or one of the class's greatest length.  A
  gram is determined by its own letters only, so an edit can only affect grams that span its place: the most that span
  any one place are the word's bound.
* Words of n letters meet words of n and n + 1 in class n, with grams of up to half as many letters, so more grams stay than
  one edit affects.  Hence the (bound + 1) rarest grams of near words have one in common, at one place or, behind
  an inserted letter, at the next: the lists of these grams are merged, and each pair that meets is verified.
* A list of over ``LIST`` words on both sides isn't paired as it is: its words meet by what is left of them without
  one letter, so that only near words meet.

A word's form is the near word with the most occurrences, if these are ``TIMES`` as many as its own.

Defined results: a null text has no word; rows without doc_id are taken as if theirs were empty; repeated rows count
again; other columns are ignored; an empty table has no word.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.llm import kernel
from skymesh.llm.frames import texts, written

LEAST, LONGEST = 7, 10
ENTRIES = 1 << 18
FEW = 32
LIST = 256
TIMES = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = np.uint64(0x9FB21C651E98DF25)
HELD = 1 << 20


# -- words ----------------------------------------------------------------------------------------
def words(docs: DataFrame, least: int = LEAST, every: int = 31, often: int = 2) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``often`` or more times."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    runs = texts(docs).select("doc_id", run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    out = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return out.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


# -- grams ----------------------------------------------------------------------------------------
def by_length(column: pa.Array):
    """(rows, code points of each) of the words of one length in turn."""
    own = column.to_numpy(zero_copy_only=False)
    size = np.array([len(w) for w in own])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, np.array(own[rows].tolist(), f"<U{n}").view(np.uint32).reshape(len(rows), n).astype(np.uint64)


def grams(codes: np.ndarray, most: int):
    """The hashes of the grams at each place, from one letter on, a letter more each time."""
    own = np.zeros(codes.shape, np.uint64)
    for q in range(1, most + 1):
        places = codes.shape[1] - q + 1
        own = kernel.mix(own[:, :places] ^ codes[:, q - 1 :]) * STEP
        yield q, own


def _counted(batches):
    held, size = [], 0

    def row():
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([kernel.int64(gram), pa.array(n)], ["gram", "n"])

    for b in batches:
        for _, codes in by_length(b.column("word")):
            for q, own in grams(codes, min(codes.shape[1] // 2, LONGEST)):
                if q > 1:
                    held.append(own.ravel())
                    size += own.size
            if size > HELD:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def dictionary(known: DataFrame, entries: int = ENTRIES, few: int = FEW) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent grams' hashes, in order, their numbers, and the number that they exceed: at most ``entries`` grams."""
    counts = written(known.select("word").mapInArrow(_counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    many = max(few, (counts.agg(F.sum("n")).first()[0] or 0) // entries)
    own = counts.filter(F.col("n") > many).toPandas()  # at most all occurrences / many
    gram = own["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], own["n"].to_numpy(np.int64)[order], many


def decomposed(codes: np.ndarray, most: int, frequent: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of each word: its gram's hash, its length (0: none ends inside the word) and its number in the dictionary."""
    known, numbers, many = frequent
    m, n = codes.shape
    gram, size, count = np.zeros((m, n), np.uint64), np.zeros((m, n), np.int64), np.zeros((m, n), np.int64)
    for q, own in grams(codes, most):
        if q == 1:
            continue
        width = own.shape[1]
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        found = known[at] == own if len(known) else np.zeros(own.shape, bool)
        ends = (size[:, :width] == 0) & (~found | (q == most))
        gram[:, :width][ends], size[:, :width][ends] = own[ends], q
        count[:, :width][ends] = np.where(found, numbers[at] if len(known) else 0, many)[ends]
    return gram, size, count


def bound(size: np.ndarray) -> np.ndarray:
    """The most grams of each word that span one place: no edit affects more."""
    m, n = size.shape
    steps = np.zeros((m, n + 1), np.int64)
    rows, at = np.nonzero(size)
    np.add.at(steps, (rows, at), 1)
    np.add.at(steps, (rows, at + size[rows, at]), -1)
    return np.cumsum(steps, 1).max(1)


def probes(size: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which grams of each word are merged: the (bound + 1) rarest, in one order of all grams, and those that tie with the last."""
    order = np.where(size > 0, np.minimum(count, 2**23).astype(np.uint64) << np.uint64(40) | gram >> np.uint64(24), np.uint64(2**64 - 1))
    last = np.take_along_axis(np.sort(order, 1), bound(size)[:, None], 1)
    return (order <= last) & (size > 0)


def list_of(gram: np.ndarray, place: np.ndarray, length: int, long: bool) -> np.ndarray:
    return kernel.mix(gram ^ kernel.mix((place.astype(np.uint64) << np.uint64(33)) + np.uint64(2 * length + long)))


def _listed(batches, frequent: tuple, least: int):
    """(list, kind, word, n): kind 0 words meet each other, kind 1 meets kind 2."""
    for b in batches:
        for rows, codes in by_length(b.column("word")):
            n, lists, kinds, whose = codes.shape[1], [], [], []
            for length in (n, n - 1):
                if length < least:
                    continue
                gram, size, count = decomposed(codes, min(length // 2, LONGEST), frequent)
                row, at = np.nonzero(probes(size, gram, count))
                own = gram[row, at]
                if length == n:
                    parts = [(list_of(own, at, n, False), 0), (list_of(own, at, n, True), 1), (list_of(own, at + 1, n, True), 1)]
                else:
                    parts = [(list_of(own, at, length, True), 2)]
                for x, kind in parts:
                    lists.append(x)
                    kinds.append(np.full(len(x), kind, np.int32))
                    whose.append(rows[row])
            take = pa.array(np.concatenate(whose))
            yield pa.RecordBatch.from_arrays([kernel.int64(np.concatenate(lists)), pa.array(np.concatenate(kinds)), b.column("word").take(take), b.column("n").take(take)], ["list", "kind", "word", "n"])


# -- pairs ----------------------------------------------------------------------------------------
def _met(lists: DataFrame, keys: list[str]) -> DataFrame:
    a, b = (lists.filter(f"kind in {k}").select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "kind"))) for k, x in (((0, 1), "a"), ((0, 2), "b")))
    met = a.join(b, keys).filter("a_kind + b_kind > 0 or a_word < b_word").filter((F.abs(F.length("a_word") - F.length("b_word")) <= 1) & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select("a_word", "a_n", "b_word", "b_n")


def near_words(known: DataFrame, least: int = LEAST, entries: int = ENTRIES, few: int = FEW, at_most: int = LIST) -> DataFrame:
    """(a_word, a_n, b_word, b_n): each pair of near words of (word, n) once."""
    frequent = dictionary(known, entries, few)
    lists = written(known.select("word", "n").mapInArrow(partial(_listed, frequent=frequent, least=least), "list bigint, kind int, word string, n bigint"), "lists")
    size = lists.groupBy("list").agg(F.count_if(F.col("kind") < 2).alias("a"), F.count_if(F.col("kind") != 1).alias("b"))
    long = written(size.filter(F.least("a", "b") > at_most).select("list"), "long-lists")
    pairs = _met(lists.join(long, "list", "left_anti"), ["list"])

    # of long lists: without the letter at each place, and of the shorter words as they are
    places = F.sequence(F.lit(1), F.length("word"))
    cut = F.transform(places, lambda i: F.struct(F.when(F.col("kind") == 0, i).otherwise(0).alias("at"), F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)).alias("rest")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("word").alias("rest")))
    rest = lists.join(long, "list").withColumn("x", F.explode(F.when(F.col("kind") == 1, whole).otherwise(cut)))
    pairs = pairs.unionByName(_met(rest.select("list", "kind", "word", "n", "x.at", "x.rest"), ["list", "at", "rest"]))
    return pairs.distinct()


# -- forms ----------------------------------------------------------------------------------------
def variants(docs: DataFrame, least: int = LEAST, every: int = 31, often: int = 2, times: int = TIMES, **index) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    known = written(words(docs, least, every, often), "words")
    pairs = near_words(known, least, **index)
    both = pairs.unionByName(pairs.select(F.col("b_word").alias("a_word"), F.col("b_n").alias("a_n"), F.col("a_word").alias("b_word"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a_word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b_word")).alias("best"))
    good = -F.col("best.less") >= times * F.col("n")
    own = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best.b_word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    own = written(own, "forms")

    # a form has at least ``times`` as many occurrences, so a way of forms is short; each round doubles what is followed
    most = own.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(times, most), times)))
    ways = own.filter("form is not null").select("word", F.col("form").alias("root"))

    def doubled(w: DataFrame, _: int) -> DataFrame:
        on = w.select(F.col("word").alias("root"), F.col("root").alias("next"))
        return w.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))

    ways = reduce(doubled, range(max(0, math.ceil(math.log2(steps)))), ways)
    return own.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
