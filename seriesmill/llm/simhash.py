"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of at most four differing bits,
either one segment has none, or two segments have at most one each (pigeonhole). So a
fingerprint gets as keys its three exact segments, and for each pair of segments the indices
of the Golay codewords near them: nearby indices of one with the nearest of the other, and the
other way round (at most 11 keys a pair). Two fingerprints within four bits share a key.

Fingerprints are first reduced to distinct ones, so groups of copies are one row. Rows of one
key are compared in blocks of bounded size; a block sends on a spanning forest of its links,
never its pairs. Components of the forests are found with rounds of star operations whose state
is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import golay
from seriesmill.llm.components import components
from seriesmill.llm.text import as_bytes, fresh
from seriesmill.sources.tables import written

SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # lowest bit, bits
BLOCK = 4096  # fingerprints of one key that a task compares with each other
PAIRS_AT_ONCE = 1 << 21
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority of the bits of the XXH64 of all shingles; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        to = at + _HASHES_AT_ONCE
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)]
        # Sums of up to 255 rows fit in bytes.
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """``keep`` columns plus ``name``, the fingerprint of the whole text as a long; null is a text without words."""
    # numbered names: those of the table may hold dots or clash
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    schema = docs.select(*kept).schema.add("fp", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in as_bytes(batch.column(batch.num_columns - 1))], np.uint64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], schema.names)

    return rows.mapInArrow(each, schema).toDF(*keep, name)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for all keys of all fingerprints."""
    parts = [(fps >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.uint32) for lo, n in SEGMENTS]
    near = [golay.near(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    places, out = [], []
    every = np.arange(len(fps))
    for i, part in enumerate(parts):
        places.append(every)
        out.append(part.astype(np.int64) | i << 32)
    for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)), start=3):
        for k in range(6):
            pairs = [(near[a][:, k], near[b][:, 0])] + ([(near[a][:, 0], near[b][:, k])] if k else [])
            for x, y in pairs:
                real = np.flatnonzero((x >= 0) & (y >= 0))
                places.append(real)
                out.append(x[real] << 12 | y[real] | i << 32)
    return np.concatenate(places), np.concatenate(out)


def forest(groups: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, place) of a spanning forest of the links inside each group; equal groups are adjacent."""
    n = len(fps)
    label = np.arange(n)
    edge = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    ends = np.repeat(np.append(edge, n), np.diff(np.concatenate([[0], edge, [n]])))
    after = ends - np.arange(n) - 1  # members of the group after each place
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        x = np.repeat(np.arange(at, to), after[at:to])
        y = x + 1 + np.arange(len(x)) - (total[x] - total[at])
        # Places that are joined already need no comparison.
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        close = np.bitwise_count(fps[x] ^ fps[y]) <= distance
        x, y = x[close], y[close]
        while len(x):  # smaller label wins, then every place takes its label's label
            a, b = label[x], label[y]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            left = label[x] != label[y]
            x, y = x[left], y[left]
        at = to
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` whose components are those of all links.

    The rows of a key are cut into blocks of about ``block`` rows and every pair of blocks is a
    group of its own, so no group outgrows a task; a key with few rows has one block.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                fps = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False)
                place, key = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"key": key, "fp": fps[place]})

    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    large = rows.groupBy("key").count().filter(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    rows = rows.join(large, "key", "left").withColumn("blocks", blocks)
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the group that may go on in the next batch
        last = None
        done: np.ndarray = np.zeros((0, 2), np.int64)

        def found(rows: np.ndarray) -> np.ndarray:
            group = np.zeros(len(rows), np.int64)
            group[1:] = np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))
            fps = rows[:, 3]
            x, y = forest(group, fps.view(np.uint64))
            return np.stack([np.maximum(fps[x], fps[y]), np.minimum(fps[x], fps[y])], 1)

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "lo", "hi", "fp")], 1)
            tail = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))[-1]) + 1 if (rows[:, :3] != rows[-1, :3]).any() else 0
            if tail == 0 and (last is None or (last == rows[-1, :3]).all()):
                held.append(rows)
            else:
                done = np.unique(np.concatenate([done, found(np.concatenate([*held, rows[:tail]]))]), axis=0)
                held = [rows[tail:]]
            last = rows[-1, :3]
            if len(done) > 200_000:
                yield pa.RecordBatch.from_pydict({"a": done[:, 0], "b": done[:, 1]})
                done = done[:0]
        if held:
            done = np.unique(np.concatenate([done, found(np.concatenate(held))]), axis=0)
        if len(done):
            yield pa.RecordBatch.from_pydict({"a": done[:, 0], "b": done[:, 1]})

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id among all rows reachable over links of at most four
    differing bits (null ids only count where a component has no other). Null, empty and blank
    texts have fingerprint zero and link like any other; rows that repeat an id each get a row.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = written(with_fingerprint(ids, ["id"], width=width), "fingerprints")
    return labelled(prints).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def labelled(prints: DataFrame) -> DataFrame:
    """``prints`` (``id`` and ``fp``) plus ``component`` (its least fingerprint) and ``component_id`` (its least id)."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints-distinct")
    label = components(written(links(distinct), "fingerprint-links"))  # node, component
    joined = distinct.join(label, distinct.fp == label.node, "left")
    joined = joined.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    first = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(first, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """One row of each near-duplicate group, all columns: that with the group's smallest id.

    Rows that repeat an id are told apart by their fingerprint, then by a digest of all their
    columns as JSON, which may be of any type, and then are equal; a group whose ids are all
    null keeps one row. Columns may have any names.
    """
    columns = docs.columns
    fp, key, row = (fresh(c, columns) for c in ("__fp", "__id", "__row"))
    prints = written(with_fingerprint(docs, columns, text, width, fp), "documents-with-fingerprint")
    slim = prints.select(F.col(f"`{id_col}`").alias("id"), F.col(fp).alias("fp"))
    counted = slim.groupBy("id", "fp").agg(F.count("*").alias("n"))
    named = written(labelled(counted), "fingerprint-labels").filter("id <=> component_id")
    # One fingerprint for each component: of several rows with its smallest id, that of the least.
    kept = named.groupBy("component").agg(F.first("component_id").alias("component_id"), F.min(F.struct("fp", "n")).alias("r"))
    kept = written(kept.select(F.col("component_id").alias(key), F.col("r.fp").alias(fp), F.col("r.n").alias(row)), "fingerprint-kept")
    same = prints[f"`{id_col}`"].eqNullSafe(kept[key]) & (prints[fp] == kept[fp])
    all_columns = [F.col(f"`{c}`") for c in columns]
    once = prints.join(kept.filter(F.col(row) == 1), same, "left_semi").select(*all_columns)
    again = prints.join(kept.filter(F.col(row) > 1), same, "left_semi").groupBy(F.col(f"`{id_col}`").alias(key), F.col(fp))
    whole = F.struct(*all_columns)
    again = again.agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(row)).select(*[F.col(row)[c].alias(c) for c in columns])
    return once.union(again)
