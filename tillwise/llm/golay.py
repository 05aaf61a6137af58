"""The binary Golay code of length 23: decoding vectors of 23 bits to the nearest codeword.

The code is perfect: every vector is at most three bits from exactly one codeword. Flipping
one bit of a vector decodes to one of at most six codewords, so vectors that differ in up to
two bits, which both are one flip from a common vector, share at least one of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(vector: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if vector >> bit & 1:
            vector ^= GENERATOR << bit - CHECK_BITS
    return vector


def _errors() -> np.ndarray:
    """The lightest error of each remainder."""
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            vector = sum(1 << bit for bit in bits)
            errors[_remainder(vector)] = vector
    return errors


REMAINDER_OF_HIGH = np.array([_remainder(high << CHECK_BITS) for high in range(1 << LENGTH - CHECK_BITS)], np.int64)
ERROR_OF_REMAINDER = _errors()


def index(vectors: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword, 12 bits."""
    remainder = REMAINDER_OF_HIGH[vectors >> CHECK_BITS] ^ (vectors & ((1 << CHECK_BITS) - 1))
    return (vectors ^ ERROR_OF_REMAINDER[remainder]) >> CHECK_BITS


def near_indices(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords that a vector reaches by at most one flip in its low ``width`` bits."""
    flips = np.array([0, *(1 << bit for bit in range(width))], np.int64)
    reached = np.sort(index(vectors[:, None] ^ flips), axis=1)
    is_new = np.ones(reached.shape, bool)
    is_new[:, 1:] = reached[:, 1:] != reached[:, :-1]
    rows, _ = np.nonzero(is_new)
    return rows, reached[is_new]
