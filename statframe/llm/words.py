"""Words of a batch of texts as numpy arrays: byte ranges, owning row and a 64-bit hash each.

A batch's UTF-8 bytes are classified by a 256-entry table, so a word pattern must be a class of bytes (all bytes from 0x80 up
belong together). A word's hash is a polynomial over a fixed table of byte values modulo 2**64, taken from prefix sums, then mixed.
Equal words always have equal hashes; where a false match would change a result the caller compares the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: arrays of this many 8-byte numbers stay small, in several workers of an executor.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

#: Fixed classes of bytes, as the contracts state them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n at least; grown by doubling."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * SLICE_BYTES)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        full = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
        _power, _inverse = full(_BASE), full(back)
    return _power, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, row after the last, their bytes, and offsets of the rows in those bytes. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words of one slice: ``start``, ``end`` byte ranges, ``hash``, and ``first``: the index of each row's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] = inside[1:-1][edge]
        ends[edge - 1] = inside[1:-1][edge - 1]
        self.data, self.start, self.end = data, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_LOWER[data] * power[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; meaningless where the row has fewer left."""
        total = np.zeros(len(self.hash), np.uint64)
        for k in range(min(size, len(self.hash))):
            total[: len(total) - k] += mix(self.hash[k:] + np.uint64(0xD1B54A32D192ED03 * (k + 1) % 2**64))
        return mix(total)


def shingle_sets(column: pa.Array, size: int, kind: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; rows with fewer words than ``size`` have their whole sequence as one."""
    for first, last, data, offsets in texts(column):
        words = Words(data, offsets, kind)
        grams = words.shingles(size)
        for row in range(first, last):
            a, b = words.first[row - first], words.first[row - first + 1]
            if b - a >= size:
                yield row, np.unique(grams[a : b - size + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for k, h in enumerate(words.hash[a:b]):
                    one += mix(np.array([h], np.uint64) + np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64))
                yield row, mix(one + np.uint64(b - a))
            else:
                yield row, np.zeros(0, np.uint64)
