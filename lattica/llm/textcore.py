"""Vectorised word segmentation and hashing over the UTF-8 bytes of Arrow string columns.

Every separator the contracts name is an ASCII byte, and no byte of a multi-byte UTF-8 character is
below 0x80, so words can be cut on bytes. All functions work on a *slice*: the texts of some rows laid
end to end (``data``) with the rows' byte offsets (``off``). Null texts count as empty. Memory is about
30 bytes per byte of a slice, and a slice is about ``SLICE_BYTES`` or one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64


def _bytes_except(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.ones(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = False
    return mask


#: ``[^\x20\x09-\x0D]+``
BLANK_WORDS = _bytes_except((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM_WORDS = _bytes_except((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, byte offsets of the rows and of the end)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, body = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words(NamedTuple):
    """Byte starts and ends of the words; ``first[r]:first[r + 1]`` are those of row r."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < n]
    begins[at] = inside[at]
    at = off[1:][off[1:] > 0] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Poly:
    """Hash of any range of a sequence from prefix sums of value * base**place, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), _powers(base, 1), _powers(base, 1)

    def __call__(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        if n + 1 > len(self.up):
            m = 1 << max(16, (n + 1).bit_length())
            self.up, self.down = _powers(self.base, m), _powers(self.inverse, m)
        total = np.zeros(n + 1, _U)
        np.cumsum(values * self.up[:n], out=total[1:])
        return (total[end] - total[start]) * self.down[start]


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_over_bytes, _over_words, _over_words_too = _Poly(0xD6E8FEB86659FD93), _Poly(0xA0761D6478BD642F), _Poly(0xE7037ED1A0B428DB)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    return mix(_over_bytes(_BYTES[data], start, end) + (end - start).astype(_U))


def hash_windows(word_hash: np.ndarray, start: np.ndarray, end: np.ndarray, *, second: bool = False) -> np.ndarray:
    """64-bit hash of each range of words; ``second``: an independent one, for 128 bits together."""
    return mix((_over_words_too if second else _over_words)(word_hash, start, end) + (end - start).astype(_U))


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of each window of ``size`` words that lies within one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    skip = first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(len(row)) + skip[row], row


def covered(start: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of ``start``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the flags of each row's words."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
