"""Vectorised word handling for Arrow batches of text.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of those are ASCII, so the
definition is the same on UTF-8 bytes as on code points, and a whole batch can be cut into words
with a few numpy passes over its byte buffer, without a Python object per word.

Word hashes are polynomial hashes modulo 2**64 over randomised byte values, taken as differences of
one running sum per batch and then mixed.  They do not depend on the position of the word, the
batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds the numpy temporaries (about 60 bytes per byte of text).
CHUNK_BYTES = 1 << 19

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_WORD_BASE = pow(int(_ODD), -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value per byte; of the lower-casing table, A-Z share the values of a-z.
BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        up = np.full(size, _ODD, dtype=np.uint64)
        down = np.full(size, _U(_WORD_BASE), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["p"][:n], _powers["q"][:n]


@dataclass
class Words:
    """The words of a chunk: byte ranges in ``data`` and, per document, ranges of words."""

    data: np.ndarray  # uint8, the chunk's text
    text_start: np.ndarray  # int64, per document, with a last entry for the end
    start: np.ndarray  # int64, first byte of each word
    end: np.ndarray  # int64, byte after each word
    first: np.ndarray  # int64, per document the index of its first word, with a last entry

    @property
    def n_docs(self) -> int:
        return len(self.text_start) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of its A-Z lowered bytes)."""
        up, down = _power(len(self.data) + 1)
        terms = (LOWER_VALUES if lower else BYTE_VALUES)[self.data]
        terms *= up[:-1]
        running = np.empty(len(terms) + 1, dtype=np.uint64)
        running[0] = 0
        np.cumsum(terms, out=running[1:])
        h = running[self.end]
        h -= running[self.start]
        h *= down[self.start]
        h += (self.end - self.start).astype(np.uint64)
        return _mix(h)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents whose bytes lie between consecutive offsets."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    offs = (offsets - base).astype(np.int64)
    inside = np.zeros(len(part) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[part]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a document border also ends a word
    edges = np.unique(offs[1:-1])
    edges = edges[(edges > 0) & (edges < len(part))]
    cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)] if len(edges) else edges
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return Words(part, offs, starts, ends, np.searchsorted(starts, offs))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[tuple[slice, Words]]:
    """Pieces of a batch with about ``size`` bytes of text each, whole documents only."""
    size = size or CHUNK_BYTES
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield slice(i, j), find_words(data, offsets[i : j + 1])
        i = j


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries (len - n + 1 of them), order-sensitive."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m] * _ODD
    for i in range(1, n):
        out += h[i : i + m]
        out *= _ODD
    return _mix(out)


def shingles(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-word shingles and, per document, their ranges.

    A document of fewer than n words has its whole sequence as one shingle; one without words none.
    """
    counts = words.counts
    number = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    full = combine(h, n)
    long = counts >= n
    out = np.empty(int(first[-1]), dtype=np.uint64)
    if long.any():
        src = ranges(words.first[:-1][long], number[long])
        out[ranges(first[:-1][long], number[long])] = full[src]
    for d in np.flatnonzero((counts > 0) & ~long):
        a, b = int(words.first[d]), int(words.first[d + 1])
        out[first[d]] = combine(h[a:b], b - a)[0]
    return out, first


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + l)."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, dtype=np.int64)[keep], lengths[keep]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def unique_per_doc(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and their ranges."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(len(first))).astype(np.int64)


def binary_column(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary entry per range of a contiguous array."""
    width = values.dtype.itemsize
    offs = (np.asarray(first, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))])
