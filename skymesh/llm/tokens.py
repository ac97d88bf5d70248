"""Token ids in binary files whose document boundaries are Elias-Fano codes (operator 12).

A file holds documents that follow one another in ascending doc_id order.  Its parts, little-endian:

* a header line of ``HEADER`` bytes in ASCII: format, place of the task and of the file within it, documents
  without id, documents, token ids, bytes of one id (2 if the vocabulary has room, else 4), bytes of the two codes;
* the Elias-Fano code of the end offset of each document in the file's ids;
* the Elias-Fano code of the doc_ids that are not null, less the smallest;
* the concatenated ids, each document closed by ``END``; and one line end.

An Elias-Fano code of n ascending numbers up to u stores each number's low ``l`` = floor(log2(u / n)) bits as they are and
the rest in unary: bit (high + i) is set for number i.  That is at most 2 + log2(u / n) bits a number.  ``select`` finds
the i-th set bit from a sample of every ``SAMPLE``-th, so an offset takes a few words to read and no table of 64-bit offsets
exists.  Documents are dealt by ranges of doc_id, each task writes files of about ``size`` bytes as it goes, and
where a file's ids begin among all ids follows from the headers of the files before it.

A text is cut where the tokenizer would cut it anyway (``cuts``), so that each different piece is encoded by the library
once in a batch; a tokenizer that isn't known to cut there gets whole texts.

Defined results: a null text is an empty document (its end id only); rows without doc_id come first; rows with
one doc_id follow each other, in an order of their text's hash; other columns are ignored; an empty table gives no file
with documents.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skymesh.llm import kernel
from skymesh.llm.frames import scratch, texts

END = 2
FILE = 8 << 20
LOT = 4 << 20
HEADER = 128
SAMPLE = 256
FORMAT = "SKYMESH-IDS-1"
#: pieces of either age that a worker keeps with their ids, and the longest of them; others only cost time
KEPT, KEPT_BYTES = 3 << 16, 32

#: first bytes of characters that may stand beside a cut: no white space begins with them, nor is any of them ASCII white space
_BESIDE = np.zeros(256, bool)
_BESIDE[0x21:0x7F] = True
_BESIDE[0xC3:0xF5] = True
_BESIDE[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


# -- Elias-Fano -----------------------------------------------------------------------------------
class EliasFano:
    """Ascending numbers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        before = np.cumsum(ones) - ones
        # of every SAMPLE-th set bit: the byte that holds it and the set bits before that byte
        at = np.searchsorted(before, np.arange(0, n, SAMPLE), "right") - 1
        self.sample = at.astype(np.uint32), before[at].astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        table = (low[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(table.ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes()
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = np.frombuffer(data, "<u4", 4).tolist()
        return cls(n, bits, np.frombuffer(data, np.uint8, a, 16), np.frombuffer(data, np.uint8, b, 16 + a))

    def select(self, i: int) -> int:
        """The place of the i-th set bit (from 0)."""
        byte, seen = int(self.sample[0][i // SAMPLE]), int(self.sample[1][i // SAMPLE])
        while True:
            word = self.high[byte : byte + 8].tobytes()
            here = int.from_bytes(word, "little")
            if seen + here.bit_count() > i:
                break
            seen += here.bit_count()
            byte += 8
        for _ in range(i - seen):
            here &= here - 1
        return byte * 8 + (here & -here).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = i * self.low_bits
        part = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8
        return self.select(i) - i << self.low_bits | part & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """All numbers, in order."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = np.zeros(self.n, np.uint64)
        for k in range(self.low_bits):
            low |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return (high << np.uint64(self.low_bits)) | low


# -- files ----------------------------------------------------------------------------------------
class Shard:
    """A file of documents, read from its bytes; ``document(i)`` is found by selection."""

    def __init__(self, data: bytes):
        name, *rest = data[:HEADER].decode("ascii").split()
        if name != FORMAT:
            raise ValueError(f"no file of {FORMAT}")
        self.task, self.file, self.nulls, self.documents, self.tokens, width, a, b = map(int, rest[:8])
        self.least = int(rest[8])
        self.ends = EliasFano.from_bytes(data[HEADER : HEADER + a])
        self._ids = EliasFano.from_bytes(data[HEADER + a : HEADER + a + b])
        self.ids = np.frombuffer(data, f"<u{width}", self.tokens, HEADER + a + b)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self._ids[i - self.nulls] + self.least

    def doc_ids(self) -> list:
        return [None] * self.nulls + [x + self.least for x in self._ids.values().tolist()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def shard_bytes(task: int, file: int, docs: list, sizes: np.ndarray, ids: bytes, width: int) -> bytes:
    known = [x for x in docs if x is not None]
    least = known[0] if known else 0
    ends = EliasFano.of(np.cumsum(sizes)).to_bytes()
    names = EliasFano.of(np.array([x - least for x in known], np.uint64)).to_bytes()
    head = f"{FORMAT} {task} {file} {len(docs) - len(known)} {len(docs)} {len(ids) // width} {width} {len(ends)} {len(names)} {least}"
    return head.ljust(HEADER - 1).encode("ascii") + b"\n" + ends + names + ids


# -- encoding -------------------------------------------------------------------------------------
@lru_cache(4)
def loaded(path: str):
    """The tokenizer, the signs that ``cuts`` sets apart (none if it isn't known to cut there), the bytes
    of an id and the pieces met so far."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    before, model, added = own.get("pre_tokenizer") or {}, own.get("model") or {}, own.get("added_tokens") or []
    plain = own.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
    inside = "".join(x["content"] for x in added)  # never cut there; an apostrophe begins a piece with letters
    apart = np.zeros(256, bool)
    apart[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in "'" + inside]] = True
    tokenizer = Tokenizer.from_str(json.dumps(own))
    width = 2 if max(tokenizer.get_vocab_size(True), END + 1) <= 1 << 16 else 4
    plain = plain and " " not in inside and "\n" not in inside
    return tokenizer, apart if plain else None, width, [{}, {}]


def cuts(flat: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text before which a byte-level tokenizer cuts whatever else stands there, in any order: a single
    space or line end between two characters that are certainly no white space (and after such a line end), and a
    character of ``apart`` (by byte) after an ASCII letter.

    A space is joined to what follows it, a line end stands alone, a letter never is in one piece with a sign, and none
    of them looks beyond its neighbours."""
    n = len(flat)
    if n < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((flat[1:-1] == 0x20) | (flat[1:-1] == 0x0A)) + 1
    at = at[_BESIDE[flat[at + 1]]]
    first = at - 1  # the first byte of the character before
    for _ in range(3):
        first = np.where((flat[first] & 0xC0 == 0x80) & (first > 0), first - 1, first)
    at = at[_BESIDE[flat[first]]]
    signs = np.flatnonzero(apart[flat[1:]] & _LETTER[flat[:-1]]) + 1
    return np.concatenate([at, at[flat[at] == 0x0A] + 1, signs])


def encoded(texts_: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another and each closed by ``END``, and the number of ids of each text."""
    tokenizer, apart, width, kept = loaded(path)
    kind = np.dtype(f"<u{width}")
    flat, offsets = kernel.text_bytes(texts_)
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    if apart is not None:
        edge[cuts(flat, apart)] = True
    places = np.flatnonzero(edge)
    pieces = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(flat))]) if len(flat) else pa.array([], pa.large_string())
    coded = pieces.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    young, old = kept
    ids: list = [young.get(w) for w in words]
    missing = [i for i, x in enumerate(ids) if x is None]
    new = []
    for i in missing:
        w = words[i]
        x = ids[i] = old.get(w)
        if x is None:
            new.append(i)
        else:
            young[w] = x
    for a in range(0, len(new), 4096):  # the library's results are many times their ids
        part = new[a : a + 4096]
        for i, x in zip(part, tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
            own = ids[i] = np.array(x.ids, kind).tobytes()
            if len(words[i]) <= KEPT_BYTES:
                young[words[i]] = own
    if len(young) > KEPT:  # what hasn't been met since the last time goes
        kept[:] = {}, young

    # gather: the ids of each piece in turn, then the end id of each text
    size = np.array([len(x) for x in ids], np.int64) // width
    where = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(ids), f"<u{width}")
    order = coded.indices.to_numpy(zero_copy_only=False)
    count = size[order]
    before = np.append(0, np.cumsum(count))  # ids before each piece
    upto = before[np.searchsorted(places, offsets)] if len(flat) else np.zeros(len(offsets), np.int64)
    total = np.diff(upto)
    plain = np.ones(int(before[-1]), np.int64)  # places in the pool: steps of one, and a jump at each piece
    some = count > 0
    begin, source = before[:-1][some], where[order][some]
    if len(begin):
        plain[begin] = source - np.append(0, source[:-1] + count[some][:-1] - 1)
    out = np.insert(pool[np.cumsum(plain)], upto[1:], np.array(END, f"<u{width}"))
    return out, total + 1


def _lots(batches):
    """The ids and texts of about ``LOT`` bytes at a time (or one longer text): the more, the fewer different pieces."""
    names, parts, held = [], [], 0
    for batch in batches:
        for part in kernel.slices(batch, limit=LOT):
            names.append(part.column("doc_id"))
            parts.append(part.column("text").cast(pa.large_string()))
            held += part.nbytes
            if held >= LOT:
                yield pa.concat_arrays(names), pa.concat_arrays(parts)
                names, parts, held = [], [], 0
    if names:
        yield pa.concat_arrays(names), pa.concat_arrays(parts)


def _shards(batches, path: str, size: int):
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    width = loaded(path)[2]
    docs, sizes, parts, held, file = [], [], [], 0, 0

    def row():
        data = shard_bytes(task, file, docs, np.concatenate(sizes), b"".join(parts), width)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    for names, text in _lots(batches):
        ids, count = encoded(text, path)
        docs += names.to_pylist()
        sizes.append(count)
        parts.append(ids.tobytes())
        held += ids.nbytes
        if held >= size:
            yield row()
            docs, sizes, parts, held, file = [], [], [], 0, file + 1
    if docs:
        yield row()


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            own = Shard(data.as_py())
            ends = own.ends.values().astype(np.int64)
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            names = own.doc_ids()
            for a in range(0, own.documents, 1 << 16):
                b = min(own.documents, a + (1 << 16))
                crc = [zlib.crc32(own.ids[x:y].astype("<u4").tobytes()) for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * (b - a)), pa.array(names[a:b], pa.int64()), pa.array(begins[a:b]), pa.array((ends - begins)[a:b]), pa.array(crc, pa.int64())], ["path", "doc_id", "begin", "n_tokens", "ids_crc32"])


# -- jobs -----------------------------------------------------------------------------------------
def write_ids(docs: DataFrame, path: str, tokenizer: str, size: int = FILE) -> None:
    """The documents' ids as files in the folder ``path``; ``tokenizer`` is a file of the tokenizers library that
    all executors can read."""
    own = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = own.mapInArrow(partial(_shards, path=tokenizer, size=size), "value binary")
    # the writer puts the bytes of a string out as they are; each row is a file
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").filter(F.length("content") > HEADER)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, tokens) of each file: where its ids begin among the ids of all files.  One row for each file."""
    head = F.split(F.substring("content", 1, HEADER - 1).cast("string"), " +")
    known = _files(spark, path).select("path", *(head[i].cast("bigint").alias(n) for i, n in ((1, "task"), (2, "file"), (5, "tokens"))))
    # tasks first, so that the ordered sum over all of them has a row for each task only
    inside = Window.partitionBy("task").orderBy("file")
    tasks = known.groupBy("task").agg(F.sum("tokens").alias("all"))
    before = tasks.select("task", (F.sum("all").over(Window.orderBy("task")) - F.col("all")).alias("before"))
    return known.join(before, "task").select("path", (F.col("before") + F.sum("tokens").over(inside) - F.col("tokens")).alias("first"), "tokens")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of a folder: its place among all
    ids, their number and their checksum as 32-bit integers."""
    rows = _files(spark, path).mapInArrow(_read, "path string, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(offsets(spark, path), "path").select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def binary_ids(docs: DataFrame, tokenizer: str, size: int = FILE) -> DataFrame:
    """The documents' ids written to files and read back, as ``read_ids`` gives them."""
    spark = docs.sparkSession
    write_ids(docs, path := scratch(spark, "ids"), tokenizer, size)
    return read_ids(spark, path)
