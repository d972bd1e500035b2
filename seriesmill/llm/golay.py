"""The perfect binary Golay code of length 23: every word is within 3 bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


#: Remainder of each single bit: that of a word is their exclusive or.
UNITS = np.array([_remainder(1 << i) for i in range(LENGTH)], np.uint32)


def _errors() -> np.ndarray:
    """The only error of 3 bits at most that leaves each of the 2**11 remainders."""
    out = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            left = 0
            for b in bits:
                left ^= int(UNITS[b])
            out[left] = sum(1 << b for b in bits)
    return out


ERRORS = _errors()


def remainders(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint32)
    for i in range(LENGTH):
        out ^= (words >> np.uint32(i) & np.uint32(1)) * UNITS[i]
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    return (words ^ ERRORS[remainders(words)]) >> np.uint32(CHECKS)


def near(words: np.ndarray, used: int = LENGTH) -> np.ndarray:
    """Codeword indices of each word and of its neighbours at one bit (the lowest ``used`` bits), one row a word.

    Two words that differ in at most one of these bits have the nearest codeword of either in
    both rows. A row holds at most six different values; repeats are -1, the first value is
    the word's own.
    """
    left = remainders(words)
    out = np.empty((len(words), used + 1), np.int64)
    out[:, 0] = (words ^ ERRORS[left]) >> np.uint32(CHECKS)
    for i in range(used):
        flipped = words ^ np.uint32(1 << i)
        out[:, i + 1] = (flipped ^ ERRORS[left ^ UNITS[i]]) >> np.uint32(CHECKS)
    own = out[:, 0].copy()
    rest = np.sort(out[:, 1:], axis=1)
    rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
    rest[rest == own[:, None]] = -1
    rest = -np.sort(-rest, axis=1)[:, :5]
    return np.concatenate([own[:, None], rest], axis=1)
