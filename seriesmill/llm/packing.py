"""Best-fit packing of documents into sequences of fixed capacity.

Documents come in pieces of 1 to ``capacity`` tokens, so both pieces and gaps are kept
range-sorted as runs of equal size: at most ``capacity`` runs of pieces whatever the corpus.
Packing goes in supersteps from the largest size down. In each, the pieces of one size sweep
over the gaps from the smallest that fits (their successor) upwards; conflicts for a gap are
resolved by rank, pieces with lower ranks first; gaps shrink, and what is left opens sequences.
A superstep thus settles all pieces of a size at once and gives the sequences that best fit
decreasing gives one piece at a time.

Sizes are counted and ranks given in Spark: a task numbers its pieces of each size while it
tokenises, sums over tasks turn these into global ranks, and every row looks up its rank in the
broadcast plan (at most a few runs for each size) to get its sequence and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.text import as_bytes
from seriesmill.llm.tokens import word_ids
from seriesmill.sources.tables import written

PLAN = [("size", np.int64), ("rank", np.int64), ("sequence", np.int64), ("each", np.int64), ("offset", np.int64)]


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The plan for ``counts[size]`` pieces of each size, sorted by size and rank.

    A row says: from this ``rank`` on, pieces of ``size`` go to the sequences from ``sequence``
    on, ``each`` pieces to a sequence, the first at ``offset``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free places: runs (first sequence, how many)
    frees: list[int] = []  # sizes of gaps, ascending
    plan, opened = [], 0

    def add(free: int, first: int, n: int) -> None:
        if free and n:
            if not gaps[free]:
                insort(frees, free)
            gaps[free].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def place(free: int, first: int, n: int, size: int = size) -> int:
            """Put pieces into ``n`` sequences from ``first`` on; how many sequences were touched."""
            nonlocal left, rank
            each = free // size
            whole = min(n, left // each)
            rest = left - whole * each if whole < n else 0
            plan.append((size, rank, first, each, capacity - free))
            add(free - each * size, first, whole)
            if rest:
                add(free - rest * size, first + whole, 1)
            taken = whole * each + rest
            left, rank = left - taken, rank + taken
            return whole + bool(rest)

        at = bisect_left(frees, size)
        while left and at < len(frees):
            free = frees.pop(at)
            runs = gaps.pop(free)
            while left and runs:
                first, n = runs.pop()
                used = place(free, first, n)
                if used < n:
                    runs.append((first + used, n - used))
            for first, n in runs:
                add(free, first, n)
            at = bisect_left(frees, size)
        if left:
            n = -(-left // (capacity // size))
            place(capacity, opened, n)
            opened += n
    return np.array(sorted(plan), PLAN)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str, text: str) -> DataFrame:
    """Pieces of every document: its ids, then ``end``, cut where they exceed ``capacity``.

    ``task`` and ``local`` number the pieces of one length within the task that made them.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "integer"), ("local", "long")):
        schema = schema.add(name, kind)
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encode = TaskContext.get().partitionId(), Counter(), word_ids(tokenizer).encode
        for batch in batches:
            row, piece, start, length, crc, local = [], [], [], [], [], []
            for i, parts in enumerate(encode(as_bytes(batch.column("text")))):
                ids = b"".join([*parts, last])
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    local.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(local, pa.int64())],
                schema.names,
            )

    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of all documents with the sequence and offset they go to.

    A null text is empty: its document is the end id alone. Rows that repeat an id are
    documents of their own. An empty table has no pieces.
    """
    made = written(pieces(docs, tokenizer, capacity, end, id_col, text), "pieces")
    sizes = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity
    shared = docs.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))
    ranked = made.join(base.select("task", "length", "base"), ["task", "length"])
    ranked = ranked.select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("base")).alias("rank")
    )
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        top = int(plan["rank"].max(initial=0)) + 1
        keys = plan["size"] * top + plan["rank"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, size * top + np.minimum(rank, top - 1), side="right") - 1]
            far = rank - row["rank"]
            sequence, offset = row["sequence"] + far // row["each"], row["offset"] + far % row["each"] * size
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
