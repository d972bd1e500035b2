"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Labelled rows are dealt to a fixed number of shards. In each round every shard continues
follow-the-regularised-leader updates from the common state, streaming its examples, and the
states are averaged (parameter mixing). A model is 2**bits numbers whatever the input. Scores
are sparse dot products over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.text import SEGMENT, segments, slices, utf8
from seriesmill.sources.tables import written

#: Class of each byte: 0 blank, 1 letter (also every byte of a character beyond ASCII), 2 digit, 3 other.
KINDS = np.full(256, 3, np.uint8)
KINDS[[*b" \t\n\r\x0b\x0c"]] = 0
KINDS[[*range(48, 58)]] = 2
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i up to n."""
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(0)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of letters, digits or other signs, and where each run starts and ends.

    ``starts``: positions at which a run can't continue. The hash is a polynomial in the bytes,
    taken from prefix sums, so that runs of any length cost the same.
    """
    global _UP, _DOWN
    if len(_UP) <= len(data):
        _UP, _DOWN = _powers(max(len(data), 2 * SEGMENT))
    kinds = KINDS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    worded = kinds[begin] != 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[worded], end[worded]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * _DOWN[begin]), begin, end


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR offsets, buckets and values of each text: tokens and pairs of neighbours.

    A value is log2(1 + count), scaled so that a text's values have length 1. A token that
    repeats the one before it gives one common pair, so that repetition is a feature.
    """
    data, offsets = utf8(column)
    n, mask = len(column), np.uint64((1 << bits) - 1)
    keys, counts, waiting = [], [], []

    def settle(found: list[np.ndarray]) -> None:
        key, count = np.unique(np.concatenate(found), return_counts=True)
        keys.append(key)
        counts.append(count)

    last_row, last_hash = -1, np.zeros(0, np.uint64)
    for row, end, lo, hi in segments(offsets, KINDS[data] == 0):
        starts = offsets[row:end] - lo if end > row + 1 or lo == offsets[row] else np.zeros(1, np.int64)
        hashes, begin, _ = tokens(data[lo:hi], starts[starts < hi - lo])
        rows = (np.searchsorted(starts, begin, side="right") - 1 + row).astype(np.uint64)
        if row == last_row:  # the same long text goes on
            before, same = np.append(last_hash, hashes[:-1]) if len(last_hash) else hashes[:-1], hashes
            pair_rows = rows[len(rows) - len(before) :]
            same = hashes[len(hashes) - len(before) :]
        else:
            joined = rows[1:] == rows[:-1]
            before, same, pair_rows = hashes[:-1][joined], hashes[1:][joined], rows[1:][joined]
        pairs = np.where(before == same, np.uint64(0x5851F42D4C957F2D), _mix(before * np.uint64(3) + same))
        key = np.concatenate([rows << np.uint64(bits) | hashes & mask, pair_rows << np.uint64(bits) | pairs & mask])
        last_row, last_hash = row if end == row + 1 else -1, hashes[-1:] if len(hashes) else last_hash
        if end == row + 1 and hi < offsets[end]:
            waiting.append(key)
        else:
            settle([*waiting, key])
            waiting = []
    if not keys:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, count = np.concatenate(keys), np.concatenate(counts)
    where = np.searchsorted(key >> np.uint64(bits), np.arange(n + 1, dtype=np.uint64))
    values = np.log2(1.0 + count)
    squares = np.concatenate([[0.0], np.cumsum(values * values)])
    length = np.sqrt(np.maximum(squares[where[1:]] - squares[where[:-1]], 1e-12))
    values /= np.repeat(length, np.diff(where))
    return where, (key & mask).astype(np.int64), values.astype(np.float32)


@dataclass
class Ftrl:
    """State of FTRL-proximal: sums of adjusted gradients and of squared gradients; the last place is the bias."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    @classmethod
    def new(cls, bits: int) -> Ftrl:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        size = np.maximum(np.abs(z) - self.l1, 0.0)
        return -np.sign(z) * size / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example; ``at`` without repeats."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class QualityModel:
    weights: np.ndarray
    bits: int

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1; a text without tokens gets that of the bias alone."""
        z = [np.zeros(0)]
        for some in slices(column):
            where, at, values = features(some, self.bits)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[at] * values)])
            z.append(sums[where[1:]] - sums[where[:-1]])
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(z) + self.weights[-1], -35.0, 35.0)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, where: Column, bound: int) -> DataFrame:
    """About ``bound`` labelled ids at most, picked by a hash of the id; all of them if there are fewer."""
    known = labels.filter(where).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.filter("id is not null and y in (0, 1)")
    share = bound / max(known.count(), 1)
    return known if share >= 1 else known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(
    docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text: str = "text",
    label_col: str = "quality", bits: int = 18, bound: int = 24_000, shards: int = 4, rounds: int = 3,
) -> QualityModel:
    """Learn ``label_col`` (1 good, 0 bad) of labelled rows with a text that satisfy ``where`` (on the id).

    ``bound``: how many labelled ids are used, about, whatever the size of the table; their ids
    are broadcast. Without a usable row the model gives 0.5.
    """
    spark = docs.sparkSession
    wanted = F.broadcast(sample_labels(labels, id_col, label_col, where, bound))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.filter("text is not null").join(wanted, "id").select("id", "y", "text")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for some in slices(batch.column("text")):
                where, at, values = features(some, bits)
                at = [p.tobytes() for p in np.split(at.astype(np.int32), where[1:-1])]
                x = [p.tobytes() for p in np.split(values, where[1:-1])]
                own = [batch.column(c).slice(row, len(some)) for c in ("id", "y")]
                arrays = [own[0].cast(pa.string()), own[1], pa.array(at, pa.binary()), pa.array(x, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "y", "at", "x"])
                row += len(some)

    made = rows.mapInArrow(examples, "id string, y int, at binary, x binary")
    made = written(made.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))), "quality-examples")
    dealt = made.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("id"), "at", "y")
    state, size = Ftrl.new(bits), (1 << bits) + 1
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((state.z, state.n))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = None, 0
            for batch in batches:
                for y, at, x, shard in zip(*(batch.column(c).to_pylist() for c in ("y", "at", "x", "shard")), strict=True):
                    if own is None or own[0] != shard:
                        if own is not None:
                            yield _sent(*own, seen)
                        own, seen = (shard, Ftrl(shared.value[0].copy(), shared.value[1].copy())), 0
                    own[1].learn(np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64), float(y))
                    seen += 1
            if own is not None:
                yield _sent(*own, seen)

        states = dealt.mapInArrow(learn, "shard bigint, z binary, n binary, seen bigint").collect()  # one row per shard
        states.sort(key=lambda r: r["shard"])
        shared.unpersist()
        if not states:
            return QualityModel(np.zeros(size), bits)
        share = np.array([r["seen"] for r in states], float)
        share /= share.sum()
        for name in ("z", "n"):
            each = np.array([np.frombuffer(r[name], np.float32) for r in states], np.float64)
            setattr(state, name, share @ each)
    return QualityModel(state.weights(), bits)


def _sent(shard: int, state: Ftrl, seen: int) -> pa.RecordBatch:
    z, n = (x.astype(np.float32).tobytes() for x in (state.z, state.n))
    return pa.RecordBatch.from_pydict({"shard": [shard], "z": [z], "n": [n], "seen": [seen]})


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns plus the score (``name``) of every row's whole text; null counts as an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # numbered names: those of the table may hold dots or clash
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    schema = docs.select(*kept).schema.add("score", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            values = pa.array(shared.value.score(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*columns, values], schema.names)

    return rows.mapInArrow(each, schema).toDF(*keep, name)
