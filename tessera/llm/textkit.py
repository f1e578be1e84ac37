"""Vectorised text work on Arrow batches: words, rolling hashes, n-gram hashes.

Everything here is a pure function of the bytes it gets, so that equal text has
equal words and equal hashes in every task, on every executor and in reruns.
A word is a maximal run of bytes outside space and 0x09-0x0D; UTF-8 never uses
those bytes inside a longer character, so bytes and code points agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: A word, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Odd multipliers of the rolling hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

#: Text handled at a time, in bytes; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: A random-looking value for each byte, so that the rolling hash has no structure from the alphabet.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))


def release() -> None:
    """Give memory that is free in this process back to the system: workers are kept between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Powers:
    """base**i and base**-i modulo 2**64; the first `KEPT` stay in the process."""

    KEPT = 1 << 20

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        made = []
        for b in (self.base, self.inverse):
            x = np.full(max(n, 1 << 16), U(b))
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if len(made[0]) <= self.KEPT:
            self.up, self.down = made
        return made[0][:n], made[1][:n]


_powers = {b: Powers(b) for b in (BYTE_BASE, WORD_BASE)}


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """S with S[j] - S[i] the sum of values[t] * base**t for t in [i, j)."""
    up, _ = _powers[base].get(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span, the same wherever in the array the span lies."""
    _, down = _powers[base].get(len(s))
    return mix((s[ends] - s[starts]) * down[starts])


def windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of values[i : i + size] for each i."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = prefix_sums(values, base)
    _, down = _powers[base].get(len(s))
    return mix((s[size:] - s[:n]) * down[:n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Chunk:
    """Some documents' bytes, one after another, and their words.

    first .. stop: the documents' places in the batch.  offsets: len + 1 byte
    offsets.  starts, ends: of each word.  doc_words: len + 1 places in starts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        word = ~SPACE[data]
        before = np.empty(len(word) + 1, bool)
        before[0], before[1:] = False, word
        before[offsets] = False
        self.starts = np.flatnonzero(word & ~before[:-1])
        before[:-1], before[-1] = word, False
        inner = offsets[offsets < len(data)]
        before[inner] = False
        self.ends = np.flatnonzero(word & ~before[1:]) + 1
        self.doc_words = np.searchsorted(self.starts, offsets)

    @property
    def word_doc(self) -> np.ndarray:
        """The document, from 0, of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.doc_words))

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z as a-z."""
        return np.where((self.data >= 65) & (self.data <= 90), self.data | 32, self.data)

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        s = prefix_sums(BYTE_VALUE[self.data if data is None else data], BYTE_BASE)
        return span_hash(s, self.starts, self.ends, BYTE_BASE)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's documents in chunks of at most about `most` bytes, each document whole."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
