"""Words of many texts at once: numpy over the character buffer of an Arrow batch.

Texts of a batch lie one after the other in one buffer. White space, word borders and word
hashes come from whole-buffer operations, so no Python runs per word. Batches are cut into
slices of bounded size at document borders; only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return series(_BASE), series(_INVERSE)


class Texts:
    """The texts of one slice.

    data: their bytes; offsets: border of every text; start, end: words as byte ranges;
    bounds: first word of every text (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        space = IS_SPACE[data]
        before = np.ones(len(data) + 1, bool)
        before[1:] = space
        after = before[1:].copy()
        if len(data):
            before = before[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = True
            after[:-1] = space[1:]
            after[-1] = True
            inner = offsets[1:]
            after[inner[inner > 0] - 1] = True
        word = ~space
        self.start = np.flatnonzero(word & before[: len(data)])
        self.end = np.flatnonzero(word & after) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; equal words have equal hashes wherever they stand."""
        size = 1 << max(16, int(len(self.data)).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * up[: len(self.data)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix64(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_of(word: bytes) -> int:
    """The hash :meth:`Texts.hashes` gives to a word that has no white space in it."""
    data = np.frombuffer(word, np.uint8)
    return int(Texts(data, np.array([0, len(data)])).hashes()[0])


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, where, chars = filled.buffers()
    n = len(filled)
    offsets = np.frombuffer(where, np.int64)[filled.offset : filled.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
