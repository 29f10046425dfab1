"""Vectorised hashes of words and windows over the bytes of many texts.

A hash is a polynomial over random 64-bit letters modulo 2^64, so that the hash of any stretch comes
from two prefix sums; a finaliser spreads its bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
#: From so many bytes on a stretch is named by a digest, as the polynomial gives some long regular strings one name.
LONG = 128
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        for i, step in enumerate((_BASE, _INVERSE)):
            row = np.full(n + n // 4, step, np.uint64)
            row[0] = 1
            _POWERS[i] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column end to end, and where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Prefix:
    """Prefix sums over a sequence of 64-bit letters."""

    def __init__(self, letters: np.ndarray):
        up, self.down = powers(len(letters) + 1)
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * up[: len(letters)], out=self.sums[1:])

    def names(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the stretches [start, start + length)."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_LETTERS[data])


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of the first word of each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~word[:-1]
    after[:-1] |= ~word[1:]
    begin, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return begin, end, np.searchsorted(begin, at)


def stretch_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: Prefix | None = None) -> np.ndarray:
    """A 64-bit name of each stretch of bytes of any length."""
    names = (letters or byte_prefix(data)).names(begin, end - begin)
    for i in np.flatnonzero(end - begin >= LONG):
        names[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return names


def word_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return stretch_names(data, begin, end)


def slices(at: np.ndarray, limit: int):
    """Ranges of texts of at most ``limit`` bytes, or of one text."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high
        low = high


def unique_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the place of each name among them, and their counts."""
    order = np.argsort(names)
    row = names[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    rank = np.cumsum(new) - 1
    place = np.empty(len(row), np.int64)
    place[order] = rank
    return row[new], place, np.bincount(rank, minlength=int(new.sum()))
