"""Token ids of a corpus in files of Simple-8b blocks, in ascending order of document ids.

A file is a Parquet table, written by one task for its range of documents, with one row for
each chunk of whole documents: their ids and lengths, the packed words, where each block of
1,024 ids starts among the words and among the escapes, and how many ids of the task come
before. Spark's committer makes a file visible only when its task has succeeded, so a lost
executor leaves no trace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import simple8b
from seriesmill.llm.text import as_bytes
from seriesmill.llm.tokens import word_ids

#: A chunk ends with the document that brings it to so many ids.
CHUNK = 1 << 19

FILE = pa.schema([
    ("task", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("ids", pa.int64()),
    ("doc", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())),
    ("words", pa.binary()), ("block_word", pa.binary()), ("block_escape", pa.binary()), ("escapes", pa.binary()),
])
_FILE_DDL = (
    "task int, chunk int, before long, ids long, doc array<long>, length array<long>, "
    "words binary, block_word binary, block_escape binary, escapes binary"
)


def _chunk(task: int, chunk: int, before: int, held: list[bytes], doc: list[int | None], length: list[int]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), "<u4")
    words, block_word, escapes = simple8b.encode(ids)
    escaped = np.flatnonzero(words >> np.uint64(60) == simple8b.ESCAPE)
    packed = [words, block_word.astype("<i8"), np.searchsorted(escaped, block_word).astype("<i8"), escapes]
    row = [task, chunk, before, len(ids), doc, length, *(x.tobytes() for x in packed)]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, FILE, strict=True)], schema=FILE)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every row, append ``end`` to each, and write all ids in ascending order of ``id_col``.

    Null texts are empty; null ids come first; rows that repeat an id are ordered by their
    text. An empty table gives files without chunks.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, "id").sortWithinPartitions("id", "text")
    last = np.array([end], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), word_ids(tokenizer).encode
        chunk, before, size, held, doc, length = 0, 0, 0, [], [], []
        for batch in batches:
            for key, parts in zip(batch.column("id").to_pylist(), encode(as_bytes(batch.column("text"))), strict=True):
                parts = [*parts, last]
                held += parts
                doc.append(key)
                length.append(sum(map(len, parts)) // 4)
                size += length[-1]
                if size >= CHUNK:
                    yield _chunk(task, chunk, before, held, doc, length)
                    chunk, before, size, held, doc, length = chunk + 1, before + size, 0, [], [], []
        if doc:
            yield _chunk(task, chunk, before, held, doc, length)

    ranged.mapInArrow(each, _FILE_DDL).write.parquet(path)


def ids_between(words: bytes, block_word: bytes, block_escape: bytes, escapes: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a chunk; only the blocks that hold them are decoded."""
    word, escape = np.frombuffer(block_word, "<i8"), np.frombuffer(block_escape, "<i8")
    first, last = start // simple8b.BLOCK, -(-stop // simple8b.BLOCK)
    own = slice(word[first], word[last] if last < len(word) else None) if start < stop else slice(0)
    extra = slice(escape[first], escape[last] if last < len(word) else None) if start < stop else slice(0)
    ids = simple8b.decode(np.frombuffer(words, "<u8")[own], np.frombuffer(escapes, "<u8")[extra])
    at = start - first * simple8b.BLOCK
    return ids[at : at + stop - start].astype("<u4")


def read(files: DataFrame) -> DataFrame:
    """Every document of files of ``write``: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before: those of the task, and the totals of the
    tasks before it, of which there is one row each.
    """
    totals = files.groupBy("task").agg(F.sum("ids").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                starts = np.concatenate([[0], np.cumsum(np.array(one["length"], np.int64))])
                ids = ids_between(one["words"], one["block_word"], one["block_escape"], one["escapes"], 0, int(starts[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one["task"]] * len(crc), pa.int32()), pa.array(one["doc"], pa.int64()), pa.array(starts[:-1] + one["before"]),
                        pa.array(one["length"], pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["task", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    chunks = files.select("task", "before", "doc", "length", "words", "block_word", "block_escape", "escapes")
    found = chunks.mapInArrow(each, "task int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "task").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
