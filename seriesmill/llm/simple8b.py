"""Simple-8b: unsigned integers packed into 64-bit words, vectorised in both directions.

The top four bits of a word select how many values it holds and of how many bits. A run of
zeros fills a word without payload. A value that needs more than 60 bits is an escape: its
word only has selector 15, and the value stands in the list of escapes.
Values are packed in blocks that start with a fresh word, so blocks are found by their offset
and decoded on their own.
"""

from __future__ import annotations

import numpy as np

#: Values of a word and bits of each, by selector; 15 is the escape.
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 1024


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    out = np.frexp(values.astype(np.float64))[1]
    if (large := out > 53).any():  # a float may round up
        out[large] = 32 + np.frexp((values[large] >> np.uint64(32)).astype(np.float64))[1]
    return out.astype(np.int8)


def _best(bits: np.ndarray, block: int) -> np.ndarray:
    """Selector of the word that could start at each place, from the widest value of windows.

    Every block is followed by values too wide for any selector, so no window leaves it.
    """
    rows, room = -(-len(bits) // block), int(COUNTS.max())
    padded = np.full((rows, block + room), 127, np.int8)
    whole = len(bits) // block
    padded[:whole, :block] = bits[: whole * block].reshape(-1, block)
    padded[whole:, : len(bits) - whole * block] = bits[whole * block :]
    flat = padded.ravel()

    def widest(window: np.ndarray, ahead: int) -> np.ndarray:
        out = window.copy()
        if ahead:
            np.maximum(window[:-ahead], window[ahead:], out=out[:-ahead])
            out[-ahead:] = 127
        return out

    windows = {1: flat}
    while (size := max(windows)) * 2 <= room:
        windows[2 * size] = widest(windows[size], size)
    best = np.full(len(flat), ESCAPE, np.int8)
    for selector in range(14, -1, -1):
        count = int(COUNTS[selector])
        power = 1 << (count.bit_length() - 1)
        best[widest(windows[power], count - power) <= WIDTHS[selector]] = selector
    return best.reshape(rows, -1)[:, :block].ravel()[: len(bits)]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped values) of uint64 values.

    Greedy: a word takes as many values as its best selector allows. All blocks advance
    together, one word each.
    """
    n = len(values)
    values = values.astype(np.uint64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    best = _best(_lengths(values), block)
    take = np.append(COUNTS, 1)[best]
    rows, owner = [], []
    at, live = starts, np.arange(len(starts))
    while len(live):
        rows.append(at)
        owner.append(live)
        at = at + take[at]
        more = at < ends[live]
        at, live = at[more], live[more]
    first, block_of = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(first)
    first, block_of = first[order], block_of[order]
    selector = best[first].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(15):
        mine = np.flatnonzero(selector == s)
        if not len(mine) or not WIDTHS[s]:
            continue
        for k in range(COUNTS[s]):
            words[mine] |= values[first[mine] + k] << np.uint64(k * WIDTHS[s])
    escapes = values[first[selector == ESCAPE]]
    return words, np.searchsorted(block_of, np.arange(len(starts))), escapes


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All values of some words; ``escapes`` are those of these words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    take = np.append(COUNTS, 1)[selector]
    ends = np.cumsum(take)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - take
    for s in range(15):
        mine = np.flatnonzero(selector == s)
        if not len(mine) or not WIDTHS[s]:
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[first[mine] + k] = words[mine] >> np.uint64(k * WIDTHS[s]) & mask
    out[first[selector == ESCAPE]] = escapes
    return out
