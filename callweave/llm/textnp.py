"""Vectorised word spans and word hashes over the bytes of Arrow strings."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _tables():
    codes = np.arange(256)
    lower = codes.astype(np.uint8)
    lower[65:91] += 32
    word = (codes >= 128) | ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122))
    return lower, word


@functools.lru_cache(maxsize=2)
def _powers(size: int):
    """Powers of an odd base and of its inverse, modulo 2^64."""
    up = np.full(size, _BASE, np.uint64)
    up[0] = 1
    down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased (A-Z) texts.

    ``doc`` is the row of each word, ``start`` and ``end`` its bytes in ``bytes``, ``hash`` a 64-bit
    hash of it; ``first[i]:first[i+1]`` are the words of row i. Nulls and empty texts have no words.
    """

    def __init__(self, texts: pa.Array):
        lower, word = _tables()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.bytes = low = lower[raw]
        inside = word[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(low), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(low), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        size = 1 << max(20, (len(low) - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``length`` words within one row."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(length):
            total = total * _STEP + self.hash[j : j + n]
        return at, mixed(total[at])

    def text(self, begin: int, count: int) -> bytes:
        """Words begin .. begin+count joined by one space."""
        low = self.bytes
        return b" ".join(low[self.start[i] : self.end[i]].tobytes() for i in range(begin, begin + count))
