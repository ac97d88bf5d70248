"""Array helpers used inside Spark tasks: Arrow text batches to byte buffers, words and hashes.

Everything works on a bounded slice of a batch (about ``CHUNK`` bytes of text, or one longer
document), so the memory of a Python worker doesn't depend on the size of a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# word characters of the three tokenisations, by byte of the UTF-8 text
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives the hash of any span of ``codes``."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_INVERSE, len(codes)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = (sums[end] - sums[start]) * powers(_BASE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = np.uint64(0x9FB21C651E98DF25)
LONG = 512  # bytes; longer spans are hashed one by one


def byte_hash(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, eight at a time through ``mix``: not a polynomial, so no pair of texts is
    known to share it whatever the constants.  With ``span_hash`` it makes a name of 128 bits."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1B873593CC9E2D51))
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG, "left"))
    data = memoryview(np.ascontiguousarray(flat))
    for i in order[:long].tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], 0x2F0B4C47)
    order = order[long:]
    size, at = size[order], start[order]
    padded = np.append(flat, np.zeros(8, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))  # from every byte
    own = out[order]
    for k in range(-(-int(size[0]) // 8) if len(size) else 0):
        m = int(np.searchsorted(-size, -8 * k, "left"))  # longer than 8 k bytes
        rest = np.minimum(size[:m] - 8 * k, 8).astype(np.uint64)
        word = eight[at[:m] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        own[:m] = mix(own[:m] ^ word) * _STEP
    out[order] = own
    return out


def chain_hash(values: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A hash of ``size`` neighbouring values from each ``start``, each value through ``mix`` in turn."""
    if np.isscalar(size):
        own = np.full(len(start), int(size) * int(_STEP) & (1 << 64) - 1, np.uint64)
        for k in range(int(size)):
            own = mix(own ^ values[start + k]) * _STEP
        return own
    order = np.argsort(-size, kind="stable")
    size, at = size[order], start[order]
    own = size.astype(np.uint64) * _STEP
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))
        own[:m] = mix(own[:m] ^ values[at[:m] + k]) * _STEP
    out = np.empty(len(own), np.uint64)
    out[order] = own
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """Cut a batch into slices of about ``limit`` bytes of text."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 64)
    first = 0
    while first < len(size):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words of a slice: byte range, document and 64-bit hash of each.

    ``hash`` tells words apart, ``check`` is a second, independent hash; ``sequence`` sums the second, so that
    windows are checked by it."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool):
        self.flat = LOWER[flat] if lower else flat
        self.offsets = offsets
        n = len(self.flat)
        inside = is_word[self.flat]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)  # of the words of each document; the last is their number
        self.count = np.diff(self.first)
        self.hash = byte_hash(self.flat, self.start, self.end)
        self._sums = self._sequence = self._check = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix(BYTE_CODE[self.flat])
        return self._sums

    @property
    def check(self) -> np.ndarray:
        if self._check is None:
            self._check = mix(span_hash(self.sums, self.start, self.end) + np.uint64(0x2545F4914F6CDD1D))
        return self._check

    @property
    def sequence(self) -> np.ndarray:
        if self._sequence is None:
            self._sequence = prefix(self.check)
        return self._sequence

    def starts(self, size: int) -> np.ndarray:
        """First word of every run of ``size`` words inside a document."""
        at = np.arange(max(0, len(self.start) - size + 1))
        return at[at + size <= self.first[self.doc[at] + 1]]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside a document."""
        at = self.starts(size)
        return at, chain_hash(self.hash, at, size)


def int64(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())
