"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters. Letters are
compared in lower case (ASCII here; callers lower the column in the JVM first, which covers the rest).
Null and empty texts have no words. Nothing here loops over documents or words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

def _give_back() -> None:
    """Have blocks of over a megabyte returned to the system when they are freed: Spark keeps Python workers, and else each
    of them keeps the most that it ever took."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library: it does as it does
        return
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Return freed memory that lies between smaller blocks in use, too."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_give_back()

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a worker keeps 16 bytes of powers for each. Longer words are hashed alone.
_CHUNK = 1 << 17
#: Bytes of text handled at once; larger single texts are handled alone.
SLICE_BYTES = 1 << 21
SLICE_ROWS = 1 << 15


def _word_bytes() -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        lut[lo:hi] = True
    return lut


_IS_WORD = _word_bytes()
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(_CHUNK + 1, _BASE, np.uint64), np.full(_CHUNK + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, ASCII case ignored; spans are sorted, of any length, and may not overlap."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _CHUNK, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(_LOWER[data[base : ends[i]]].tobytes())
            i += 1
            continue
        sums = np.zeros(ends[j - 1] - base + 1, np.uint64)
        np.cumsum(_LETTER[data[base : ends[j - 1]]] * up[: len(sums) - 1], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * down[s]
        i = j
    return mix64(out)


@dataclass
class Words:
    """The words of a run of documents: document d has those from offsets[d] to offsets[d + 1]."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each run of width words within a document, and each document's bounds in them.

        A document of 1 to width - 1 words has one shingle, of all its words; one without words has none.
        """
        h, n = self.hashes, self.counts
        rolled = np.zeros(len(h), np.uint64)
        for k in range(width):
            part = np.zeros(len(h), np.uint64)
            part[: len(h) - k] = h[k:]
            inside = np.arange(len(h)) + k < np.repeat(self.offsets[1:], n)
            rolled = np.where(inside, rolled * np.uint64(_BASE) + part, rolled)
        local = np.arange(len(h)) - np.repeat(self.offsets[:-1], n)
        keep = (local == 0) | (local <= np.repeat(n, n) - width)
        kept = np.maximum(n - width + 1, np.minimum(n, 1))
        return mix64(rolled[keep]), np.concatenate([[0], np.cumsum(kept)])

    def distinct(self, bits: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, hash cut to so many bits, and count of each distinct word of each document, in that order."""
        return distinct(self.doc_of_word(), self.hashes, bits)


def distinct(docs: np.ndarray, hashes: np.ndarray, bits: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    key = (docs.astype(np.uint64) << np.uint64(bits)) | (hashes >> shift)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1), count


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def words_of(column: pa.Array) -> Words:
    data, bounds = raw_text(column)
    word = _IS_WORD[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = bounds[:-1][np.diff(bounds) > 0]
    start[inner] = word[inner]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, bounds, starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, bounds))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes, one row at least."""
    _, bounds = raw_text(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1), i + SLICE_ROWS)
        yield batch.slice(i, j - i)
        i = j
    trim()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def hash_text(text: str) -> int:
    """The hash of one text as a single word: what hash_spans gives for its bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])
