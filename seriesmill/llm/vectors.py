"""Vector columns as matrices, cut into numbered blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array of doubles) of vectors that hold at least one number and finite ones only."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & fine)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and len(flat) % n or pa.compute.count_distinct(pa.compute.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of up to ``most`` rows at a time."""
    ids, rows, size = [], [], 0
    for batch in batches:
        at = 0
        while at < len(batch):
            take = min(most - size, len(batch) - at)
            ids.append(batch.column("id").slice(at, take).to_numpy())
            rows.append(matrix(batch.column("v").slice(at, take)))
            size, at = size + take, at + take
            if size == most:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, size = [], [], 0
    if size:
        yield np.concatenate(ids), np.concatenate(rows)
