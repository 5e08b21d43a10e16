"""The perfect binary (23, 12) Golay code: every 23-bit word lies within 3 bits of one codeword."""

from __future__ import annotations

import numpy as np

_POLY, _CHECK = 0xC75, 11
BITS, MESSAGE = 23, 12


def _remainder(word: int) -> int:
    for k in range(BITS - 1, _CHECK - 1, -1):
        if word >> k & 1:
            word ^= _POLY << k - _CHECK
    return word


_HIGH = np.array([_remainder(m << _CHECK) for m in range(1 << MESSAGE)], np.int32)


def _leaders() -> np.ndarray:
    one = [1 << k for k in range(BITS)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    table = np.zeros(1 << _CHECK, np.int32)
    for e in errors:
        table[_remainder(e)] = e
    return table


_LEADER = _leaders()
_FLIPS = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int32)
    syndrome = _HIGH[words >> _CHECK] ^ (words & (1 << _CHECK) - 1)
    return (words ^ _LEADER[syndrome]) >> _CHECK


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords nearest to a word and to its 23 one-bit neighbours, padded with -1.

    A word within two bits of a codeword has that index alone, any other has six. Two words
    that differ in at most two bits have a neighbour in common, so they share an index.
    """
    found = np.sort(decode(words[:, None] ^ _FLIPS[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), 6), -1, np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, col]] = found[row, col]
    return out
