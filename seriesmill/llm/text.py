"""Text columns as numpy arrays, cut into segments of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SEGMENT = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def as_bytes(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null is an empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def segments(offsets: np.ndarray, cuts: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, from byte, to byte), each of about ``limit`` bytes.

    Whole rows are taken together; a longer row comes alone, in several segments that end at
    a place where ``cuts`` is true (its last byte always is one).
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        if last > row:
            yield row, last, int(offsets[row]), int(offsets[last])
            row = last
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            to = min(at + limit, end)
            if to < end:
                ahead = np.flatnonzero(cuts[to:end][: limit])
                to = to + int(ahead[0]) + 1 if len(ahead) else min(to + limit, end)
            yield row, row + 1, at, to
            at = to
        row += 1


def slices(column: pa.Array, limit: int = SEGMENT) -> Iterator[pa.Array]:
    """The column in runs of rows of about ``limit`` bytes; a longer text comes alone."""
    _, offsets = utf8(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield column.slice(row, last - row)
        row = last


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has, whatever the case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
