"""Vectorised text primitives over Arrow string buffers.

Every function works on whole batches of UTF-8 bytes at once; nothing loops over
words or shingles in Python.  Hashes are 64-bit: a polynomial prefix hash gives the
hash of any byte span by one subtraction, and a finaliser spreads its bits.

Defined results: a null text counts as the empty string; words are maximal runs of
bytes outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 5
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BLANKS = re.compile(rb"[\x20\x09-\x0D]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, b in (("_POW", BASE), ("_INV", pow(BASE, -1, 1 << 64))):
                table = np.full(n, b & (2**64 - 1), np.uint64)
                table[0] = 1
                globals()[name] = np.multiply.accumulate(table)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]]."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``size`` bytes; a longer text is alone."""
    data, offsets = raw(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_lists(body: bytes, start: int, end: int, table: bytes | None = None, between: re.Pattern[bytes] = BLANKS, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of body[start:end], lower-cased or translated by ``table``, in lists from stretches of about ``size`` bytes that end at a byte ``between`` words."""
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            found = between.search(body, stop, end)
            stop = found.start() if found else end
        part = body[start:stop]
        yield (part.translate(table) if table else part.lower()).split()
        start = stop


class Prefix:
    """Hashes of any spans of a byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of True bytes; a run ends where its row ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    if n:
        edge[1:n] = inside[1:] != inside[:-1]
        edge[0] = edge[n] = True
        edge[offsets[:-1]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts] if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[data], offsets)


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` consecutive words of one row, index of its first word)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * np.uint64(0xD1342543DE82EF95) + hashes[first + k]
    return mix(total), first


def segments(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted row index, and its length at the end."""
    return np.searchsorted(row, np.arange(n + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingle hashes of all rows, sorted within a row; where each row begins).

    A-Z are lower-cased; a row with 1 to width - 1 words has its whole sequence as one shingle."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashed = Prefix(data).spans(starts, ends)
    at = segments(row, n)
    found, first = windows(hashed, row, width)
    owner = row[first]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                has = at[short] + k < at[short + 1]
                whole[has] = whole[has] * np.uint64(0xD1342543DE82EF95) + hashed[at[short[has]] + k] + np.uint64(k + 1)
        found, owner = np.concatenate([found, mix(whole)]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[keep], owner[keep]
    return found, segments(owner, n)
