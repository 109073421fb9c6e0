"""Hashes of words and of word windows, computed over whole Arrow batches of texts with numpy.

The text column is read as one byte array; words are what stands between 0x20 and 0x09-0x0D
(these bytes never occur inside other UTF-8 characters). Every hash has 64 bits and depends on
the words alone, so equal windows hash alike in any task on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (one longer text is worked on alone).
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors, one for each place in a word or window."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(77))


class Words:
    """The words of some texts: ``hash`` and ``doc`` (row of the text) for each, in order."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        """``data``: bytes of the texts, one after another; ``at``: where each begins, and the end."""
        self.data, self.at, self.n_docs = data, at, len(at) - 1
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        word = ~gap
        first = word.copy()
        first[1:] &= gap[:-1]
        edges = at[:-1][at[:-1] < at[1:]]
        first[edges] |= word[edges]
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        # block by block, so that the arrays of 8 bytes for each byte of text stay small
        end = np.r_[self.start[1:], len(data)]
        self.hash = np.zeros(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):
            hi = max(lo + 1, int(np.searchsorted(end, self.start[lo] + BLOCK_BYTES, side="right")))
            a, b = self.start[lo], end[hi - 1]
            self.hash[lo:hi] = self._hash(data[a:b], word[a:b], self.start[lo:hi] - a)
            lo = hi

    @staticmethod
    def _hash(data: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        place = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
        np.minimum(place, _MAX_PLACE - 1, out=place)  # longer words are hashed below
        value = _BYTE[data] * _powers(_MAX_PLACE, 11)[place]
        value[~word] = 0
        size = np.add.reduceat(word.astype(np.int64), start)
        found = mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _ODD)
        for k in np.flatnonzero(size > _MAX_PLACE):
            a, n = start[k], int(size[k])
            power = _powers(1 << (n - 1).bit_length(), 11)[:n]
            found[k] = mix((_BYTE[data[a : a + n]] * power).sum(dtype=np.uint64)[None] + np.array([n], np.uint64) * _ODD)[0]
        return found

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def windows(self, size: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all windows of ``size`` words that lie in one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, self.prefix(at, size, seed)

    def prefix(self, at: np.ndarray, size: int, seed: int = 23) -> np.ndarray:
        """Hashes of the ``size`` words from each place on."""
        power = _powers(64, seed)
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total += self.hash[at + k] * power[k]
        return mix(total + np.uint64(size * int(_ODD) & (1 << 64) - 1))


_MAX_PLACE = 1 << 12


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of at most ``size`` bytes of text, or of one longer text."""
    texts = batch.column(column)
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    if not len(texts):
        return
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi - lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
