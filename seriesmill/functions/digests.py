"""MD5 of many short texts at once, in numpy: a prefix and a number each, as ``prefix`` + decimal."""

from __future__ import annotations

import hashlib
import math

import numpy as np

# Fixed values of MD5: start, shifts of the four rounds, and the order in which they read words.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))
_SINES = [math.floor(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Texts whose words fit in a core's cache together.
_AT_ONCE = 1 << 15


def _mixed(kind: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if kind == 0:
        np.bitwise_xor(c, d, out=out)
        out &= b
        out ^= d
    elif kind == 1:
        np.bitwise_xor(b, c, out=out)
        out &= d
        out ^= c
    elif kind == 2:
        np.bitwise_xor(b, c, out=out)
        out ^= d
    else:
        np.invert(d, out=out)
        out |= b
        out ^= c


def _block(words: list) -> np.ndarray:
    """Digests (n x 4 words) of messages of one block; a word is an array, or one number for all.

    The steps write to six arrays that stay in a core's cache.
    """
    n = max(np.size(w) for w in words)
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    turned, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        step, first = _WORDS[kind]
        shift = _SHIFTS[kind][i % 4]
        word = words[(step * i + first) % 16]
        _mixed(kind, b, c, d, turned)
        turned += a
        if np.ndim(word):
            turned += word
            turned += np.uint32(_SINES[i])
        else:
            turned += np.uint32((int(word) + _SINES[i]) & 0xFFFFFFFF)
        np.right_shift(turned, np.uint32(32 - shift), out=low)
        turned <<= np.uint32(shift)
        turned |= low
        turned += b
        a, b, c, d, turned = d, turned, b, c, a
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)], 1)


def decimals(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers from 0 on as ASCII digits: (places among the numbers, digits), those of a length together."""
    powers = 10 ** np.arange(1, 19)
    sizes = np.searchsorted(powers, numbers, side="right") + 1
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        for start in range(0, len(at), _AT_ONCE):
            some = at[start : start + _AT_ONCE]
            out.append((some, (numbers[some][:, None] // 10 ** np.arange(size - 1, -1, -1) % 10 + 48).astype(np.uint8)))
    return out


def halves(prefix: bytes, numbers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two halves (64-bit numbers) of the MD5 of ``prefix`` followed by each number, as ``decimals`` made them."""
    out = np.zeros((sum(len(digits) for _, digits in numbers), 2), np.uint64)
    for at, digits in numbers:
        length = len(prefix) + digits.shape[1]
        if length > 55:
            raw = b"".join(hashlib.md5(prefix + d.tobytes(), usedforsecurity=False).digest() for d in digits)
            out[at] = np.frombuffer(raw, ">u8").reshape(-1, 2)
            continue
        first, last = len(prefix) // 4, length // 4 + 1  # words that differ
        head = np.zeros(64, np.uint8)
        head[: len(prefix)] = np.frombuffer(prefix, np.uint8)
        head[56:58] = np.frombuffer(np.array([8 * length], "<u2").tobytes(), np.uint8)
        block = np.tile(head[4 * first : 4 * last], (len(digits), 1))
        block[:, len(prefix) - 4 * first : length - 4 * first] = digits
        block[:, length - 4 * first] = 0x80
        same = head.view("<u4").astype(np.uint32)
        words = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
        found = _block([words[w - first] if first <= w < last else same[w] for w in range(16)])
        out[at] = found.astype("<u4").view(np.uint8).reshape(-1, 16).view(">u8")
    return out
