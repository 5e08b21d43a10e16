"""Vectorised text helpers over Arrow string buffers.

Everything works on the UTF-8 bytes of many texts at once: words are found by a
byte table, and a word's 64-bit hash is a difference of prefix sums of a
polynomial over per-byte random values, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one vectorised step; a longer text is one step.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, dtype=np.uint64)

#: True for bytes that part words: white space only, or all ASCII that is neither letter nor digit.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
NON_WORD = np.ones(256, bool)
NON_WORD[128:] = False
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    NON_WORD[_a:_z] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=_U)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(NamedTuple):
    start: np.ndarray  # byte where each word begins, in the slice's data
    end: np.ndarray
    doc: np.ndarray  # which text of the slice holds it
    hash: np.ndarray
    first: np.ndarray  # for each text, the index of its first word; one more entry than texts


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte by byte and of the same length."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), dtype=_U, out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that depend on the bytes alone, not on their place."""
    inverse = _power(_INVERSE, len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, hashes: bool = True) -> Words:
    """The words of texts lying at offsets (from 0) in data."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = apart[data]
    starts = gap[:-1] & ~gap[1:]
    ends = ~gap[:-1] & gap[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[~gap[cut] & ~gap[cut + 1]]  # a text ends in a word and the next begins with one
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, word_hashes(data, start, end) if hashes else np.zeros(0, _U), first)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, some SLICE_BYTES at a time, so that a very long text needs little more than its words."""
    out = np.empty(len(start), _U)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(start, start[k] + SLICE_BYTES)))
        base = start[k]
        out[k:stop] = span_hash(prefix_hash(data[base : end[stop - 1]]), start[k:stop] - base, end[k:stop] - base)
        k = stop
    return out


def grams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (of whatever text: the caller drops runs that cross texts)."""
    if len(word_hash) < n:
        return np.zeros(0, _U)
    total = np.zeros(len(word_hash) + 1, _U)
    np.cumsum(word_hash * _power(_BASE, len(word_hash)), dtype=_U, out=total[1:])
    return mix((total[n:] - total[:-n]) * _power(_INVERSE, len(word_hash))[: len(word_hash) - n + 1], n)


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """UTF-8 characters of each span."""
    chars = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:], dtype=chars.dtype)
    return (chars[end] - chars[start]).astype(np.int64)
