"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting reads every labelled row once; a task keeps one count vector per language and
sends only buckets it has seen, which are summed before the driver gets them (at most
languages x buckets numbers). The log-probability matrix is broadcast, its size is fixed by
the same product, and whole texts are scored in numpy: two gathers and a segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.text import SEGMENT, utf8

UNKNOWN = "und"
_LETTERS = np.zeros(0, np.uint32)


def _letters(points: np.ndarray) -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else."""
    global _LETTERS
    if not len(_LETTERS):
        one = (chr(i) for i in range(0x10000))
        _LETTERS = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in one), np.uint32, 0x10000)
    out = _LETTERS[np.minimum(points, 0xFFFF)]
    if (far := points > 0xFFFF).any():
        seen, back = np.unique(points[far], return_inverse=True)
        low = [ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, seen.tolist())]
        out[far] = np.array(low, np.uint32)[back]
    return out


def _grams(letters: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the bigram and trigram that end at each letter or gap, and which of them count.

    A gap (any run of other characters, and the start of a text) is one blank: grams with two
    blanks side by side don't count.
    """
    before = np.empty_like(letters)
    before[1:], before[:1] = letters[:-1], 0
    before[starts] = 0
    earlier = np.empty_like(letters)
    earlier[1:], earlier[:1] = before[:-1], 0
    earlier[starts] = 0
    two = (letters > 0) | (before > 0)
    three = two & ((before > 0) | (earlier > 0))
    shift = np.uint32(32 - bits)
    mixed = letters * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)
    pair = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    mixed = mixed + earlier * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    triple = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    return pair, two, triple, three


def gram_batches(
    column: pa.Array, bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, start of each piece, has a letter, pair, two, triple, three) in bounded pieces.

    A text over the segment size comes in several pieces; two characters of what went before
    go along and only serve as context.
    """
    data, offsets = utf8(column)
    first = (data & 0xC0) != 0x80  # of each character
    at, n = 0, len(offsets) - 1
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, max(at, int(offsets[row])) + SEGMENT, side="right")) - 1
        if end > row and at <= offsets[row]:
            lo, hi, rows = int(offsets[row]), int(offsets[end]), np.arange(row, end)
            context = 0
        else:
            lo, end = max(at, int(offsets[row])), row + 1
            hi, rows = min(lo + SEGMENT, int(offsets[end])), np.array([row])
            while hi < offsets[end] and not first[hi]:
                hi += 1
            back, context = lo, 0
            while back > offsets[row] and context < 2:
                back -= 1
                context += int(first[back])
            lo = back
        points = np.frombuffer(data[lo:hi].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(first[lo:hi])])
        starts = chars[offsets[rows] - lo] if len(rows) > 1 or context == 0 else np.zeros(1, np.int64)
        letters = _letters(points)
        real = starts[starts < len(letters)]
        pair, two, triple, three = _grams(letters, real, bits)
        two[:context] = three[:context] = False
        known = letters > 0
        yield rows, starts, known, pair, two, triple, three
        at = hi
        row = end if hi >= offsets[end] else row


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of each piece; pieces may be empty."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    sizes = np.diff(np.append(starts, len(values)))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


@dataclass
class LanguageModel:
    """Log probabilities by bucket and language, and of each language."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray
    bits: int

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior probability; ``und`` and 0 without a letter."""
        n, k = len(column), len(self.languages)
        total, known = np.zeros((n, k)), np.zeros(n, bool)
        for rows, starts, letters, pair, two, triple, three in gram_batches(column, self.bits):
            known[rows] |= _sums(letters[:, None], starts)[:, 0] > 0
            if k:
                # Bucket 2**bits is a row of zeros: for grams that don't count.
                none = np.uint32(1 << self.bits)
                values = self.table[np.where(two, pair, none)]
                values += self.table[np.where(three, triple, none)]
                total[rows] += _sums(values, starts)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total += self.prior
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[i] if y else UNKNOWN for i, y in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, bits: int = 16,
    smoothing: float = 0.5, most_languages: int = 1000,
) -> LanguageModel:
    """Learn from all rows with a text and a language (and ``where``, if given).

    More than ``most_languages`` languages are an error: the model is languages x 2**bits numbers.
    """
    used = docs if where is None else docs.filter(where)
    rows = used.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages if executors can hold the model")
    buckets = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name in set(names).difference(seen):
                seen[name] = np.zeros(buckets + 1, np.int64)
            own = [seen[x] for x in names]
            for row in own:
                row[-1] += 1
            order = {id(v): k for k, v in enumerate(seen.values())}
            place = np.array([order[id(v)] for v in own], np.int64)
            for rows, starts, _, pair, two, triple, three in gram_batches(batch.column("text"), bits):
                of = np.repeat(place[rows] * buckets, np.diff(np.append(starts, len(pair))))
                counts = np.bincount(of[two] + pair[two], minlength=len(seen) * buckets)
                counts += np.bincount(of[three] + triple[three], minlength=len(seen) * buckets)
                for k, total in enumerate(seen.values()):
                    total[:-1] += counts[k * buckets : (k + 1) * buckets]
        for name, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at.astype(np.int32), "n": total[at]})

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((buckets + 1, len(languages)))
    counts[found["bucket"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), found["lang"])] = found["n"]
    grams = counts[:-1] + smoothing
    table = np.zeros((buckets + 1, len(languages)), np.float32)
    table[:-1] = np.log(grams / grams.sum(0)) if languages else 0
    return LanguageModel(languages, np.log(counts[-1] / max(counts[-1].sum(), 1)), table, bits)


def predict(
    docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns plus language and score (``names``) of every row, from its whole text.

    Null texts and texts without a letter give ``und`` and 0, as does a model without languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # numbered names: those of the table may hold dots or clash
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    schema = docs.select(*kept).schema.add("language", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, values = shared.value.predict(batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(language, pa.string()), pa.array(values)], schema.names)

    return rows.mapInArrow(score, schema).toDF(*keep, *names)
