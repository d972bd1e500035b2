"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words (runs of letters, digits or other signs) become ids: a shape, which its last sign decides,
and hash bits. A class is one of the most frequent ids or a shape. The network sees the two
words on either side of a masked one, the near two as classes and the far two coarsely, and
gives a distribution over the class of the word between them; the word's share within its
class comes from corpus counts. A document's score is the sum over all its words of
log P(class | both sides) + log P(word | class).

Every document is counted: ids in a first pass, windows with their middle class in a second.
The number of windows is fixed, so what tasks send, already summed, is bounded for each task
and the totals are a bounded table. On it the network is trained in numpy, full batch, every
window weighted by its count. A last pass looks up the network's log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.quality import KINDS, tokens
from seriesmill.llm.text import segments, slices, utf8

HASH_BITS, SHAPES = 12, 16
IDS = SHAPES << HASH_BITS
FREQUENT = 15
CLASSES = 1 + FREQUENT + SHAPES  # 0: outside the document
COARSE = 4
WINDOWS = COARSE * CLASSES * CLASSES * COARSE


def _shapes() -> np.ndarray:
    """Shape by a word's last byte: 12 for small letters, then capitals, digits, other signs, the rest."""
    out = np.full(256, 15)
    out[:128] = 14
    out[97:123] = np.arange(26) % 12
    out[65:91] = 12
    out[48:58] = 13
    return out


_SHAPE = _shapes()


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts in a row, and the offsets of each text."""
    data, offsets = utf8(column)
    ids, rows = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for row, end, lo, hi in segments(offsets, KINDS[data] == 0):
        starts = np.maximum(offsets[row:end] - lo, 0)
        hashes, begin, stop = tokens(data[lo:hi], starts[starts < hi - lo])
        shape = _SHAPE[data[lo:hi][stop - 1]].astype(np.uint64)
        ids.append((shape << np.uint64(HASH_BITS) | hashes & np.uint64((1 << HASH_BITS) - 1)).astype(np.uint16))
        rows.append(np.searchsorted(starts, begin, side="right") - 1 + row)
    return np.concatenate(ids), np.searchsorted(np.concatenate(rows), np.arange(len(column) + 1))


def _windows(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the window around each word."""
    coarse = _COARSE[classes]
    n = len(classes)
    starts, ends = offsets[:-1], offsets[1:]
    place = np.arange(n) - np.repeat(starts, ends - starts)  # within its document
    after = np.repeat(ends, ends - starts) - np.arange(n) - 1

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        if n > abs(step):
            if step < 0:
                out[-step:] = np.where(place[-step:] >= -step, values[:step], 0)
            else:
                out[:-step] = np.where(after[:-step] >= step, values[step:], 0)
        return out

    number = beside(coarse, -2) * CLASSES + beside(classes, -1)
    return (number * CLASSES + beside(classes, 1)) * COARSE + beside(coarse, 2)


#: Coarse class: outside, a frequent word, a word of letters, anything else.
_COARSE = np.array([0] + [1] * FREQUENT + [2] * 13 + [3, 3, 2], np.int32)


def _parts(numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    near = numbers // COARSE
    return near // CLASSES // CLASSES, near // CLASSES % CLASSES, near % CLASSES, numbers % COARSE


class WindowNetwork:
    """Embeddings of the four places of a window, summed, tanh, softmax over classes."""

    def __init__(self, hidden: int = 32, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        sizes = (COARSE, CLASSES, CLASSES, COARSE)
        self.inputs = [r.normal(0, 0.3, (s, hidden)) for s in sizes]
        self.bias = np.zeros(hidden)
        self.out = r.normal(0, 0.3, (hidden, CLASSES))
        self.out_bias = np.zeros(CLASSES)

    def forward(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log probabilities of the classes; no word is of class 0."""
        h = np.tanh(sum(e[p] for e, p in zip(self.inputs, _parts(numbers), strict=True)) + self.bias)
        z = h @ self.out + self.out_bias
        z[:, 0] = -np.inf
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, numbers: np.ndarray, counts: np.ndarray, steps: int = 150, rate: float = 0.02) -> list[float]:
        """Adam on the mean loss of all counted words; gives the loss of every step."""
        total = counts.sum()
        parts = _parts(numbers)
        values = [*self.inputs, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
        losses = []
        for step in range(1, steps + 1):
            h, logs = self.forward(numbers)
            losses.append(-float((counts[:, 1:] * logs[:, 1:]).sum() / total))
            off = (np.exp(logs) * counts.sum(1, keepdims=True) - counts) / total
            back = off @ self.out.T * (1 - h * h)
            grads = []
            for e, p in zip(self.inputs, parts, strict=True):
                g = np.zeros_like(e)
                np.add.at(g, p, back)
                grads.append(g)
            grads += [back.sum(0), h.T @ off, off.sum(0)]
            for v, g, (a, b) in zip(values, grads, moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-12)
        return losses


@dataclass
class MaskedModel:
    classes: np.ndarray  # of each id
    within: np.ndarray  # log P(id | class)
    given: np.ndarray  # log P(class | window)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and summed log probability of each text."""
        counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for some in slices(column):
            ids, offsets = word_ids(some)
            classes = self.classes[ids]
            logs = self.given[_windows(classes, offsets), classes] + self.within[ids]
            total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
            counts.append(np.diff(offsets))
            sums.append(total[offsets[1:]] - total[offsets[:-1]])
        return np.concatenate(counts), np.concatenate(sums)


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all texts of what ``add`` counts in each: ``size`` numbers at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for some in slices(batch.column(0)):
                add(total, some)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({"k": at[k : k + (1 << 16)], "n": total[at[k : k + (1 << 16)]]})

    found = rows.mapInArrow(each, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["k"]] = found["n"]
    return out


def fit(docs: DataFrame, text: str = "text") -> MaskedModel:
    """Counts over all texts of the table, and the network trained on them."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")

    def add_ids(total: np.ndarray, some: pa.Array) -> None:
        total += np.bincount(word_ids(some)[0], minlength=IDS)

    counts = _summed(rows, IDS, add_ids)
    classes = (1 + FREQUENT + (np.arange(IDS) >> HASH_BITS)).astype(np.int32)
    top = np.argsort(-counts, kind="stable")[:FREQUENT]
    top = top[counts[top] > 0]
    classes[top] = 1 + np.arange(len(top))
    shared = context.broadcast(classes)

    def add_windows(total: np.ndarray, some: pa.Array) -> None:
        ids, offsets = word_ids(some)
        own = shared.value[ids]
        cells = _windows(own, offsets) * np.int32(CLASSES) + own
        total += np.bincount(cells, minlength=len(total))

    cells = _summed(rows, WINDOWS * CLASSES, add_windows).reshape(WINDOWS, CLASSES)
    network = WindowNetwork()
    seen = np.flatnonzero(cells.sum(1))
    if len(seen):
        network.fit(seen, cells[seen].astype(np.float64))
    given = network.forward(np.arange(WINDOWS))[1].astype(np.float32)
    smooth = counts + 0.5
    within = np.log(smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes]).astype(np.float32)
    return MaskedModel(classes, within, given)


def score(docs: DataFrame, model: MaskedModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``log_prob`` (summed) and ``mean_log_prob`` of every row's whole text.

    Null, empty and blank texts have no words: 0, 0.0 and a null mean.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("id").schema.add("n_tokens", "long").add("log_prob", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, logs = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(logs)], schema.names)

    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return rows.mapInArrow(each, schema).select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
