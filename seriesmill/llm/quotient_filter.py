"""Counting quotient filters over keys of a fixed number of bits, without loss.

A key goes through an invertible permutation. The upper bits of the result, the quotient, are
not stored: entries are sorted, and a filter keeps how many entries each quotient has. The lower
bits, the remainder, are stored whole, so keys come back exactly. A counter is a byte; larger
ones stand in a list of their own. Sorted filters merge like sorted lists, and a filter splits
at any quotient into filters of ranges of keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_ROUNDS = 3
_ESCAPE = 255


class Permutation(NamedTuple):
    """Multiplication by an odd number and a shift, three times, on ``width`` bits (1 to 64)."""

    width: int

    def _parts(self) -> tuple[np.uint64, np.uint64]:
        return np.uint64((1 << self.width) - 1), np.uint64((self.width + 1) // 2)

    def forward(self, keys: np.ndarray) -> np.ndarray:
        mask, shift = self._parts()
        x = keys.astype(np.uint64)
        for _ in range(_ROUNDS):
            x = x * np.uint64(_ODD) & mask
            x ^= x >> shift
        return x

    def backward(self, permuted: np.ndarray) -> np.ndarray:
        mask, shift = self._parts()
        inverse = np.uint64(pow(_ODD, -1, 1 << 64))
        x = permuted.astype(np.uint64)
        for _ in range(_ROUNDS):
            x ^= x >> shift
            x = x * inverse & mask
        return x


class Counts(NamedTuple):
    """Permuted keys, ascending and each once, and their counts."""

    keys: np.ndarray
    n: np.ndarray


def counted(keys: np.ndarray) -> Counts:
    """Of permuted keys in any order."""
    found, n = np.unique(keys, return_counts=True)
    return Counts(found.astype(np.uint64, copy=False), n.astype(np.int64, copy=False))


def merged(filters: Iterable[Counts]) -> Counts:
    """Counts of equal keys added up."""
    some = [f for f in filters if len(f.keys)]
    if len(some) < 2:
        return some[0] if some else Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, n = np.concatenate([f.keys for f in some]), np.concatenate([f.n for f in some])
    order = np.argsort(keys, kind="stable")  # runs that are sorted already
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return Counts(keys[first], np.add.reduceat(n[order], first))


def split(own: Counts, width: int, bits: int) -> Iterator[tuple[int, Counts]]:
    """(upper ``bits`` bits, entries with them), for each that has entries."""
    if not len(own.keys):
        return
    upper = own.keys >> np.uint64(width - bits) if bits else np.zeros(len(own.keys), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(upper)], strict=True):
        yield int(upper[a]), Counts(own.keys[a:b], own.n[a:b])


def packed(own: Counts) -> bytes:
    """The filter in bytes; a remainder has as many whole bytes as leave about one entry to a quotient."""
    n = len(own.keys)
    if not n:
        return np.zeros(5, "<i8").tobytes()
    low, high, whole = int(own.keys[0]), int(own.keys[-1]), 0
    while (high >> 8 * whole) - (low >> 8 * whole) > 4 * n:
        whole += 1
    quotients = (own.keys >> np.uint64(8 * whole) if whole < 8 else np.zeros(n, np.uint64)) - np.uint64(low >> 8 * whole)
    runs = np.bincount(quotients.astype(np.int64))
    size = 1 if runs.max() < 1 << 8 else 4
    remainders = own.keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :whole]
    large = own.n >= _ESCAPE
    head = np.array([n, low >> 8 * whole, whole, size, len(runs)], "<u8")
    parts = [head, runs.astype(f"<u{size}"), remainders, np.where(large, _ESCAPE, own.n).astype(np.uint8), own.n[large].astype("<i8")]
    return b"".join(p.tobytes() for p in parts)


def unpacked(body: bytes) -> Counts:
    n, first, whole, size, quotients = np.frombuffer(body, "<u8", 5).tolist()
    if not n:
        return Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = 40
    runs = np.frombuffer(body, f"<u{size}", quotients, at).astype(np.int64)
    at += size * quotients
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :whole] = np.frombuffer(body, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    counts = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    large = counts == _ESCAPE
    counts[large] = np.frombuffer(body, "<i8", int(large.sum()), at + n)
    upper = np.repeat(np.arange(quotients, dtype=np.uint64) + np.uint64(first), runs)
    keys = keys.view("<u8").ravel().astype(np.uint64)
    return Counts(keys | upper << np.uint64(8 * whole) if whole < 8 else keys, counts)
