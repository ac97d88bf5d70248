"""Benchmark decontamination with suffix arrays of the training text (operator 2).

Each slice of documents is a shard.  Its words become letters, in order of their hashes, and all its suffixes
(each up to the end of its document) are sorted by prefix doubling, as deep as the longest item.  Every test
suffix that begins a window is searched in every shard by bisection; its matches are one range of the array,
at whose positions the document words are hit.  A suffix with a word that a shard doesn't have can't match
there and isn't searched; a shard that has all words of no window needs no array.  Matches on one diagonal
that touch are put together to the longest verbatim match and its place (of equally long ones the first in the
document, then the item first in order of the ids as strings).

Words are told apart by two independent hashes of 64 bits.  The test side is checked: up to ``block_bytes`` it
is sent to all tasks as a whole; beyond, it is cut into blocks of about that size by a hash of the item, each
of which is searched against all rows, and its matches written, before the next one is collected.  Documents
are never exchanged (with more than one block the hits of a document are put together by doc_id and text).

Defined results: null or empty texts have no words, no hits, no items and the hash of the empty string;
items without a word or without item_id have no windows; items that share an item_id count once; an
empty benchmark hits nothing; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymesh.llm.frames import filtered_in_place, texts, written
from skymesh.llm.kernel import ALNUM, Words, slices, text_bytes

BITS = 24
MATCHED = "doc_id bigint, text_key bigint, n_words bigint, spans array<bigint>, items array<string>, longest struct<less: bigint, start: bigint, item: string>"
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_words bigint, longest_item string, longest_start bigint"


def _rows(ids: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width byte keys, in the order of the words: up to ``width`` ids from each position, none
    from ``end`` on."""
    there = at[:, None] + np.arange(width)
    grid = np.where(there < end[:, None], ids[np.minimum(there, len(ids) - 1)], 0)
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * width}").ravel()


def sorted_suffixes(letter: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The positions of a shard in order of the letters (from 1) that follow, each up to its ``end``: names of
    1, 2, 4, ... letters, until they differ or name at least ``depth``."""
    rank, step, place = letter.astype(np.int64), 1, np.arange(len(letter))
    while True:
        inside = np.flatnonzero(place + step < end)
        key = rank << 32
        key[inside] |= rank[inside + step]
        order = np.argsort(key, kind="stable")
        own = key[order]
        new = np.append(0, np.cumsum(own[1:] != own[:-1]))
        step *= 2
        if new[-1] == len(letter) - 1 or step >= depth:
            return order
        rank[order] = new + 1


class TestSuffixes:
    """The windows of a block of items: distinct ones, and the items and places that have each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        words = Words(*text_bytes(pa.array([x for _, x in items], pa.string())), ALNUM, lower=True)
        self.names = [x for x, _ in items]
        self.vocabulary, first = np.unique(words.hash, return_index=True)
        self.check = words.check[first]
        ids = np.searchsorted(self.vocabulary, words.hash) + 1
        self.depth = int(words.count.max(initial=0))
        length = np.minimum(words.count, size)[words.doc]
        end = words.first[words.doc + 1]
        at = np.flatnonzero(np.arange(len(ids)) + length <= end)
        at = at[(words.count[words.doc[at]] >= size) | (at == words.first[words.doc[at]])]
        there = at[:, None] + np.arange(size)
        grid = np.where(there < (at + length[at])[:, None], ids[np.minimum(there, max(0, len(ids) - 1))], 0) if len(at) else np.zeros((0, size), np.int64)
        # one entry for each different window; windows that differ in length are different
        order = np.lexsort(grid.T[::-1])
        new = np.append(True, (grid[order][1:] != grid[order][:-1]).any(1))[: len(order)]
        self.grid, self.length = grid[order][new], length[at][order][new]
        entry = np.cumsum(new) - 1  # of each (item, place) in order
        item, place = words.doc[at][order], (at - words.first[words.doc[at]])[order]
        # an item of one window can't match any further, so only a text's first occurrence of it counts
        alone = words.count[item] <= size
        self.places = [(np.searchsorted(entry[x], np.arange(len(self.grid) + 1)), item[x], place[x]) for x in (~alone, alone)]

    def match(self, words: Words):
        """(position, entry) of every window that begins in a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.grid) or not len(words.hash):
            return none, none
        letters, first, letter = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(letters, self.vocabulary), len(letters) - 1)
        has = (letters[at] == self.vocabulary) & (words.check[first[at]] == self.check)
        here = np.append(0, np.where(has, at + 1, -1))[self.grid]  # the windows in letters of the shard
        entry = np.flatnonzero((here >= 0).all(1))
        if not len(entry):
            return none, none
        here, end = here[entry], words.first[words.doc + 1]
        array = sorted_suffixes(letter + 1, end, max(self.size, self.depth))
        suffixes = _rows(letter + 1, array, end[array], self.size)
        low = np.ascontiguousarray(here.astype(">u4")).view(f"S{4 * self.size}").ravel()
        here[np.arange(self.size) >= self.length[entry][:, None]] = 0xFFFFFFFF
        high = np.ascontiguousarray(here.astype(">u4")).view(f"S{4 * self.size}").ravel()
        lo, hi = np.searchsorted(suffixes, low, "left"), np.searchsorted(suffixes, high, "right")
        n = hi - lo
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return array[np.repeat(lo, n) + step], np.repeat(entry, n)


def met(pos, entry, length, begin, item, place) -> tuple[np.ndarray, ...]:
    """Occurrences with each place of their entry: (position, length, item, place)."""
    n = begin[entry + 1] - begin[entry]
    at = np.repeat(begin[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(pos, n), np.repeat(length, n), item[at], place[at]


def _match(batches, items, size: int):
    tests = TestSuffixes(items, size)
    for batch in batches:
        for part in slices(batch):
            words = Words(*text_bytes(part.column("text")), ALNUM, lower=True)
            pos, entry = tests.match(words)
            length = tests.length[entry]
            doc = words.doc[pos]
            spans = [[] for _ in range(part.num_rows)]
            found = [set() for _ in range(part.num_rows)]
            longest: list = [None] * part.num_rows
            if len(pos):
                key = np.unique(np.stack([doc, pos - words.first[doc], length]), axis=1)
                for d, s, n in key.T.tolist():
                    spans[d].append(s << BITS | n)
                # every occurrence with every place of its window in a longer item, the first one with the others
                order = np.lexsort((pos, entry, doc))
                new = np.append(True, (entry[order][1:] != entry[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
                p, m, item, place = map(np.concatenate, zip(*(met(pos, entry, length, *x) for pos, entry, length, x in ((pos, entry, length, tests.places[0]), (*(y[order[new]] for y in (pos, entry, length)), tests.places[1]))), strict=True))
                diagonal = p - place
                order = np.lexsort((p, diagonal, item))
                p, m, item, diagonal = p[order], m[order], item[order], diagonal[order]
                d = words.doc[p]
                new = np.append(True, (p[1:] != p[:-1] + 1) | (diagonal[1:] != diagonal[:-1]) | (item[1:] != item[:-1]) | (d[1:] != d[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(p)) - 1
                run = p[last] + m[last] - p[first]
                for d, i, n, s in zip(d[first].tolist(), item[first].tolist(), run.tolist(), (p[first] - words.first[d[first]]).tolist(), strict=True):
                    found[d].add(tests.names[i])
                    best = (-n, s, tests.names[i])
                    if longest[d] is None or best < longest[d]:
                        longest[d] = best
            types = {"spans": pa.list_(pa.int64()), "items": pa.list_(pa.string()), "longest": pa.struct([("less", pa.int64()), ("start", pa.int64()), ("item", pa.string())])}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_words": pa.array(words.count, pa.int64())}
                | {k: pa.array(v, types[k]) for k, v in (("spans", spans), ("items", [sorted(x) for x in found]), ("longest", [x and dict(zip(("less", "start", "item"), x, strict=True)) for x in longest]))}
            )


def _finish(batches):
    for b in batches:
        rows = []
        for n, spans, items in zip(b.column("n_words").to_pylist(), b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            hit = 0
            if spans:
                at = np.array(spans, np.int64)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at >> BITS, 1)
                np.add.at(edge, (at >> BITS) + (at & (1 << BITS) - 1), -1)
                hit = int((np.cumsum(edge) > 0).sum())
            own = sorted(set(items))
            rows.append((hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
        hit, m, digest, bad = zip(*rows, strict=True) if rows else ((), (), (), ())
        longest = b.column("longest").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(m, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array([x and -x["less"] for x in longest], pa.int64()), pa.array([x and x["item"] for x in longest], pa.string()), pa.array([x and x["start"] for x in longest], pa.int64())],
            [x.split()[0] for x in RESULT.split(", ")],
        )


def _judged(batches, items, size: int):
    return _finish(_match(batches, items, size))


def blocks_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    return tests, -(-(tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] + 1) // block_bytes)


def items_of(tests: DataFrame, k: int, blocks: int) -> list[tuple[str, str]]:
    return [(r.item_id, r.text) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, each judged by its own text, whatever its doc_id."""
    tests, blocks = blocks_of(benchmark, block_bytes)
    if blocks == 1:
        return filtered_in_place(docs, partial(_judged, items=items_of(tests, 0, 1), size=size), "contaminated")
    # a block sees its own items only: verdicts are put together by text, then rows are judged by it
    key = F.xxhash64(docs["text"].cast("string"))
    found = contamination(docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"]), benchmark, size, block_bytes)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad"))
    return docs.join(bad, key == bad["bad"], "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): hits by windows of ``benchmark`` (item_id, text),
    the verdict, and the longest verbatim match with its item and first word."""
    own = texts(docs).withColumn("text_key", F.xxhash64("text"))
    tests, blocks = blocks_of(benchmark, block_bytes)
    found = None
    for k in range(blocks):
        one = own.mapInArrow(partial(_match, items=items_of(tests, k, blocks), size=size), MATCHED)
        if blocks > 1:
            one = written(one, "decontamination")
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        merged = found.groupBy("doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.min("longest").alias("longest"), (F.count(F.lit(1)) / blocks).cast("int").alias("copies"))
        found = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
    return found.mapInArrow(_finish, RESULT)
