"""Words of a whole Arrow batch at once, as offsets into one byte buffer.

A word is a run of `[^\\x20\\x09-\\x0D]` in the UTF-8 bytes of a text. Null texts
have none. Nothing here looks at one word at a time in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# A batch is worked on in pieces of about this many bytes of text; a longer text is a piece.
PIECE_BYTES = 4 << 20

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[list(SPACES)] = False


@dataclass
class Words:
    data: np.ndarray      # bytes of all texts, one after the other
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    first: np.ndarray     # first[i]:first[i + 1] are the words of text i

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        return b" ".join(self.data[self.start[a]:self.end[b - 1]].tobytes().split()) if b > a else b""


def pieces(array: pa.Array, limit: int = PIECE_BYTES):
    """(first row, rows) of consecutive pieces of a string array of about `limit` bytes."""
    offsets = _offsets(array)
    at = 0
    while at < len(array):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(array))
        yield at, stop - at
        at = stop


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings without nulls (a null is an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def _offsets(array: pa.Array) -> np.ndarray:
    if not len(array):
        return np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int32)
    return raw[array.offset:array.offset + len(array) + 1].astype(np.int64)


def split(array: pa.Array, lower: bool = False) -> Words:
    """The words of every text; `lower` turns A-Z into a-z first."""
    offsets = _offsets(array)
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - base
    if size == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, np.zeros(len(offsets), dtype=np.int64))
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8, count=size, offset=base)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _IN_WORD[data]
    edge = np.zeros(size + 1, dtype=bool)          # a text starts here
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:size]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:size]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets, side="left"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * step
        have += take
        step = step * step
    return out[:n]


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over all bytes."""
    if not len(words.start):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        n = len(words.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        value = sums[words.end] - sums[words.start]
        # base ** -start makes the value the same wherever the word stands
        return mix(value * _powers(BASE_INVERSE, n)[words.start] + (words.end - words.start).astype(np.uint64))


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive items; the caller drops those that cross texts."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashed[:n].copy()
        for i in range(1, k):
            out = mix(out) + hashed[i:i + n]
        return mix(out)
