"""Masked pseudo-likelihood of documents over real words, from tables that grow with the corpus.

A word is a 64-bit id: 60 bits of its hash and the shape that its last sign decides. The network
of ``masked_lm`` gives the class of a masked word (one of the most frequent words, or a shape)
from the words on both sides; the word itself is conditioned on its real neighbours:

    P(w | both sides) = a * P(class of w | window) * P(w | class)
                      + b * P(w | word before) + c * P(w | word after)

a + b + c = 1, so this is a distribution over words. The last two come from counts of
neighbouring words over the whole corpus without the masked place itself: a text seen once
does not vouch for itself. b and c grow with how often the neighbour was seen.

Texts are kept as chunks of word numbers. Each chunk asks for the counts of its words and
pairs; requests are dealt out by ranges of the ids, summed over all chunks and answered in the
order they came. No task holds more than a chunk or a range, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.masked_lm import _SHAPE, CLASSES, FREQUENT, SHAPES, WINDOWS, WindowNetwork, _windows
from seriesmill.llm.quality import KINDS, _mix, tokens
from seriesmill.llm.text import segments, slices, utf8
from seriesmill.sources.tables import written

#: Words of a chunk; a longer text comes alone.
CHUNK = 1 << 21
#: A neighbour seen so often (beside the masked place) has half of the weight it can get.
HALF = 20.0
EDGE = np.uint64(0)  # stands before and after a text
_LOW = np.uint64(15)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts in a row, and the number of words of each text."""
    data, offsets = utf8(column)
    ids, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row, end, lo, hi in segments(offsets, KINDS[data] == 0):
        starts = np.maximum(offsets[row:end] - lo, 0)
        hashes, begin, stop = tokens(data[lo:hi], starts[starts < hi - lo])
        ids.append((hashes & ~_LOW) | _SHAPE[data[lo:hi][stop - 1]].astype(np.uint64))
        rows.append(np.searchsorted(starts, begin, side="right") - 1 + row)
    return np.concatenate(ids), np.bincount(np.concatenate(rows), minlength=len(column))


def chunks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``chunk``, ``ids`` and ``lengths`` of its texts, ``words`` (distinct) and ``places`` (which word stands where)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"chunk long, ids array<{kind}>, lengths binary, words binary, places binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lengths, found, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            words, at, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = pa.concat_arrays(ids)
            ids_list = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            parts = (np.concatenate(lengths), words[order], rank[at])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids_list, *(pa.array([pack(p)], pa.binary()) for p in parts)], ["chunk", "ids", "lengths", "words", "places"])

        for batch in batches:
            at = 0
            for some in slices(batch.column("text")):
                own, n = word_ids(some)
                if size and size + len(own) > CHUNK:
                    yield made()
                    ids, lengths, found, size, number = [], [], [], 0, number + 1
                ids.append(batch.column("id").slice(at, len(some)))
                lengths.append(n)
                found.append(own)
                size, at = size + len(own), at + len(some)
        if ids:
            yield made()

    return rows.mapInArrow(each, schema)


def laid_out(lengths: np.ndarray, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a chunk with an edge before, between and after the texts that have any; and where its words are in it."""
    lengths = lengths[lengths > 0].astype(np.int64)
    at = np.arange(len(places)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(places) + len(lengths) + 1, EDGE)
    out[at] = words[places]
    return out, at


def pairs(row: np.ndarray) -> np.ndarray:
    """Id of each pair of neighbours."""
    return _mix(_mix(row[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * np.uint64(3) + row[1:])


def _read(batch: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, ...]:
    return tuple(unpack(batch.column(c)[k].as_py()) for c in ("lengths", "words", "places"))


def answers(parts: DataFrame, bits: int) -> DataFrame:
    """Counts over the whole corpus of each chunk's words and pairs, in ``2**bits`` ranges of their ids.

    Rows of chunk -1 hold the most frequent words of a range, their counts and the words of each shape.
    """
    shift = np.uint64(64 - bits)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << shift

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lengths, words, places = _read(batch, k)
                row, _ = laid_out(lengths, words, places)
                out = []
                own = np.append(words, EDGE)
                n = np.append(np.bincount(places.astype(np.int64), minlength=len(words)), np.count_nonzero(lengths))
                order = np.argsort(own)
                for ids, count in ((own[order], n[order]), np.unique(pairs(row), return_counts=True)):
                    cut = [0, *np.searchsorted(ids, edges).tolist(), len(ids)]
                    spans = list(zip(cut[:-1], cut[1:], strict=True))
                    out += [[pack(np.diff(ids[a:b], prepend=np.uint64(0))) for a, b in spans], [pack(count[a:b]) for a, b in spans]]
                number = len(edges) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number), pa.int32()), pa.array(np.full(number, batch.column("chunk")[k].as_py()), pa.int64()), *(pa.array(o, pa.binary()) for o in out)],
                    ["part", "chunk", "words", "n_words", "pairs", "n_pairs"],
                )

    def add(group: pa.Table) -> pa.Table:
        out = []
        for ids_col, n_col in (("words", "n_words"), ("pairs", "n_pairs")):
            ids = [np.cumsum(unpack(x), dtype=np.uint64) for x in group.column(ids_col).to_pylist()]
            counts = np.concatenate([unpack(x) for x in group.column(n_col).to_pylist()])
            known, at = np.unique(np.concatenate(ids), return_inverse=True)
            total = np.bincount(at, counts, minlength=len(known)).astype(np.int64)
            cut = np.cumsum([len(x) for x in ids])[:-1]
            out.append([pack(x) for x in np.split(total[at], cut)])
            if ids_col == "words":
                real = known != EDGE
                known, total = known[real], total[real]
                top = np.lexsort((known, -total))[:FREQUENT]
                shapes = np.bincount((known & _LOW).astype(np.int64), total, minlength=SHAPES)
                facts = [pack(known[top]), pack(total[top]), pack(shapes)]
        return pa.table(
            {
                "chunk": pa.array([*group.column("chunk").to_pylist(), -1], pa.int64()), "part": pa.array([group.column("part")[0].as_py()] * (len(group) + 1), pa.int32()),
                "words": pa.array([*out[0], facts[0]], pa.binary()), "pairs": pa.array([*out[1], facts[1]], pa.binary()), "shapes": pa.array([None] * len(group) + [facts[2]], pa.binary()),
            }
        )

    asked = parts.mapInArrow(ask, "part int, chunk long, words binary, n_words binary, pairs binary, n_pairs binary")
    return asked.groupBy("part").applyInArrow(add, "chunk long, part int, words binary, pairs binary, shapes binary")


def classes(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Class of each word; ``frequent``: the words with a class of their own."""
    out = 1 + FREQUENT + (words & _LOW).astype(np.int32)
    for k, word in enumerate(frequent):
        out[words == word] = 1 + k
    return out.astype(np.int32)


def _counted_windows(parts: DataFrame, frequent: np.ndarray) -> np.ndarray:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WINDOWS * CLASSES, np.int64)
        for batch in batches:
            for k in range(len(batch)):
                lengths, words, places = _read(batch, k)
                own = classes(words, frequent)[places]
                offsets = np.append(0, np.cumsum(lengths.astype(np.int64)))
                total += np.bincount(_windows(own, offsets) * np.int32(CLASSES) + own, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({"k": at[k : k + (1 << 16)], "n": total[at[k : k + (1 << 16)]]})

    found = parts.select("lengths", "words", "places").mapInArrow(each, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WINDOWS * CLASSES, np.int64)
    out[found["k"]] = found["n"]
    return out.reshape(WINDOWS, CLASSES)


def mixed(from_class: np.ndarray, before: np.ndarray, with_before: np.ndarray, after: np.ndarray, with_after: np.ndarray) -> np.ndarray:
    """Probability of each masked word: counts of its neighbours and of the pairs it makes, its own place included."""
    out, left = np.zeros(len(from_class)), np.ones(len(from_class))
    for seen, together in ((before - 1, with_before - 1), (after - 1, with_after - 1)):
        weight = 0.5 * seen / (seen + HALF)
        out += weight * together / np.maximum(seen, 1)
        left -= weight
    return out + left * from_class


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``log_prob`` (summed) and ``mean_log_prob`` of every row's whole text.

    The corpus is ``docs`` itself. Null, empty and blank texts have no words: 0, 0.0 and a null mean.
    """
    parts = written(chunks(docs, id_col, text), "lm-chunks")
    bits = max(8, parts.count().bit_length())
    known = written(answers(parts, bits), "lm-counts")
    facts = known.filter("chunk = -1").select("words", "pairs", "shapes").collect()  # one row a range
    words = np.concatenate([np.zeros(0, np.uint64), *(unpack(f["words"]) for f in facts)])
    counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(f["pairs"]) for f in facts)]).astype(np.int64)
    top = np.lexsort((words, -counts))[:FREQUENT]
    frequent = words[top]
    shapes = np.sum([np.zeros(SHAPES, np.int64), *(unpack(f["shapes"]).astype(np.int64) for f in facts)], axis=0)
    np.subtract.at(shapes, (frequent & _LOW).astype(np.int64), counts[top])
    totals = np.ones(CLASSES)  # words of each class
    totals[1 : 1 + len(top)] = counts[top]
    totals[1 + FREQUENT :] = np.maximum(shapes, 1)
    cells = _counted_windows(parts, frequent)
    network = WindowNetwork()
    seen = np.flatnonzero(cells.sum(1))
    if len(seen):
        network.fit(seen, cells[seen].astype(np.float64))
    given = np.exp(network.forward(np.arange(WINDOWS))[1]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, totals, given))
    id_type = parts.schema["ids"].dataType.elementType
    kind = id_type.simpleString()

    def each(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        frequent, totals, given = shared.value
        lengths, words, places = _read(chunk, 0)
        order = np.argsort(replies.column("part").to_numpy())
        count = {}
        for c in ("words", "pairs"):
            column = replies.column(c).to_pylist()
            count[c] = np.concatenate([unpack(column[k]) for k in order]).astype(np.float64)
        own = np.append(words, EDGE)
        of_word = np.empty(len(own))
        of_word[np.argsort(own)] = count["words"]
        row, at = laid_out(lengths, words, places)
        seen = np.full(len(row), of_word[-1])
        seen[at] = of_word[places]
        _, which = np.unique(pairs(row), return_inverse=True)
        together = count["pairs"][which]
        del which, row
        cls = classes(words, frequent)
        own_class = cls[places]
        offsets = np.append(0, np.cumsum(lengths.astype(np.int64)))
        from_class = given[_windows(own_class, offsets), own_class] * (of_word[:-1] / totals[cls])[places]
        logs = np.log(mixed(from_class, seen[at - 1], together[at - 1], seen[at + 1], together[at]))
        total = np.append(0.0, np.cumsum(logs))
        ids = chunk.column("ids").combine_chunks().flatten()
        return pa.table({"id": ids, "n_tokens": pa.array(lengths.astype(np.int64)), "log_prob": total[offsets[1:]] - total[offsets[:-1]]})

    replies = known.filter("chunk >= 0").select("chunk", "part", "words", "pairs")
    scored = parts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(each, f"id {kind}, n_tokens long, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
