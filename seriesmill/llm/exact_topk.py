"""Exact k highest integer inner products by distributed histogram selection.

Each round scores every row against a block of queries, in numpy and without keeping a score:
a task counts its scores in equal bins of each query's interval, the counts are summed, and
the interval shrinks to the bin that holds the k-th highest score. When few rows are left
above its lower end, or it is one number wide, a last pass keeps the scores from there on; of
equal ones a task keeps the k smallest ids. A block of queries has a bounded size and is
broadcast; blocks come one after the other, each against all rows.
"""

from __future__ import annotations

import bisect
import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.vectors import finite, gathered, matrix
from seriesmill.sources.tables import written

QUERY_BLOCK = 2048
BINS = 64
ROWS_AT_ONCE = 1024
#: Scores up to here are exact in the products of doubles.
_DOUBLE = 1 << 53
_LOWEST = np.iinfo(np.int64).min


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * v)


def _scores(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, exact: bool) -> np.ndarray:
    """Scores (queries x rows) as longs; a query's own rows get the lowest long."""
    out = (queries @ v.T).astype(np.int64) if exact else queries.astype(np.int64) @ v.T.astype(np.int64)
    at = np.searchsorted(query_ids, ids)
    own = np.flatnonzero(query_ids[np.minimum(at, len(query_ids) - 1)] == ids)
    out[at[own], own] = _LOWEST
    return out


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < k]


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k highest scores of each query.

    A vector is floor(``scale`` x component); a score is the inner product; ties go to the smaller
    id. ``is_query`` is a condition on the columns of ``df``. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part. Rows that repeat a
    query's id are one query (the least vector) and no candidates of it; other repeated rows
    are candidates each. With fewer than k candidates all are returned. Vectors with very large
    components are scored one by one in whole numbers of any size; only a query whose components
    don't fit in a long, or a returned score that doesn't, is an error.
    """
    spark = df.sparkSession
    rows = finite(df, id_col, vector)
    queries = finite(df.filter(is_query), id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    queries = written(queries, "topk-queries")
    size = F.array_max(F.transform("v", lambda x: F.abs(x * scale))) + 1.0  # a double: nothing overflows
    d = int(rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1)
    largest = math.isqrt(((1 << 62) - 2) // d)  # products of vectors up to here fit in a long
    small = size <= F.lit(0.999 * largest)
    most = int(rows.filter(small).agg(F.max(size).alias("most")).first()["most"] or 0) + 1
    if queries.filter(size >= F.lit(float(1 << 62))).head(1):
        raise ValueError("a query's components don't fit in a long")
    odd = rows.filter(~small)

    def blocks(some: DataFrame) -> list[DataFrame]:
        n = -(-some.count() // QUERY_BLOCK)
        return [some.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b) for b in range(n)]

    usual, big = blocks(queries.filter(small)), blocks(queries.filter(~small))
    found = [_of_block(rows.filter(small), some, k, scale, most * most * d + 1) for some in usual]
    if usual and odd.head(1):
        found += [_of_odd(odd, some, k, scale) for some in usual]
    found += [_of_odd(rows, some, k, scale) for some in big]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = [f if "fits" in f.columns else f.withColumn("fits", F.lit(True)) for f in found]
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    score = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error("scores don't fit in a long").cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _exactly(x: float, scale: int) -> int:
    return math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x)


def _of_odd(rows: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Each task's k best rows of each query in whole numbers of any size; an error if one of the k best of all doesn't fit."""
    spark = rows.sparkSession
    table = queries.toArrow()  # a block
    own = [(i, [_exactly(x, scale) for x in v]) for i, v in zip(table["id"].to_pylist(), table["v"].to_pylist(), strict=True)]
    shared = spark.sparkContext.broadcast(own)
    limit = 1 << 63

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in shared.value]  # (-score, id), the worst is first to go
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                v = [_exactly(x, scale) for x in v]
                for mine, (q, w) in zip(best, shared.value, strict=True):
                    if i != q:
                        if len(v) != len(w):
                            raise ValueError("vectors differ in length")
                        bisect.insort(mine, (-sum(map(operator.mul, v, w)), i))
                        del mine[k:]
        flat = [(q, i, -s) for mine, (q, _) in zip(best, shared.value, strict=True) for s, i in mine]
        if flat:
            fits = [-limit <= s < limit for _, _, s in flat]
            scores = [min(max(s, -limit), limit - 1) for _, _, s in flat]
            yield pa.RecordBatch.from_pydict({"query_id": [f[0] for f in flat], "vec_id": [f[1] for f in flat], "score": scores, "fits": fits})

    return rows.mapInArrow(each, "query_id long, vec_id long, score long, fits boolean")


def _of_block(rows: DataFrame, queries: DataFrame, k: int, scale: int, bound: int) -> DataFrame:
    """Each task's k best of the rows that can be among the k best of the block's queries."""
    spark = rows.sparkSession
    table = queries.toArrow()  # a block
    order = np.argsort(ids := table["id"].to_numpy())
    ids, q = ids[order], _whole(matrix(table["v"].combine_chunks()), scale)[order]
    exact = bound < _DOUBLE
    shared = spark.sparkContext.broadcast((ids, q))
    n = len(ids)
    low, high = np.full(n, -bound, np.int64), np.full(n, bound, np.int64)  # the interval: low <= score < high
    above = np.zeros(n, np.int64)  # scores from high on
    open_ = np.ones(n, bool)
    while open_.any():
        state = spark.sparkContext.broadcast((low, high, np.flatnonzero(open_)))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            query_ids, own = shared.value
            low, high, live = state.value
            low, high = low[live, None], high[live, None]
            width = -((low - high) // BINS)
            total = np.zeros(len(live) * BINS, np.int64)
            for some, v in gathered(batches, ROWS_AT_ONCE):
                score = _scores(some, _whole(v, scale), query_ids, own, exact)[live]
                inside = (score >= low) & (score < high)
                bins = (score - low) // width + np.arange(len(live))[:, None] * BINS
                total += np.bincount(bins[inside], minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"q": live[seen // BINS], "bin": seen % BINS, "n": total[seen]})

        counted = rows.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()
        histogram = np.zeros((n, BINS), np.int64)
        histogram[counted["q"], counted["bin"]] = counted["n"]
        from_top = np.cumsum(histogram[:, ::-1], axis=1)[:, ::-1]  # in this bin and those above
        reached = from_top + above[:, None] >= k
        for i in np.flatnonzero(open_):
            if not reached[i].any():  # fewer than k candidates: all of them
                open_[i] = False
                continue
            b = int(np.flatnonzero(reached[i])[-1])
            width = -((low[i] - high[i]) // BINS)
            above[i] += from_top[i, b + 1] if b + 1 < BINS else 0
            low[i], high[i] = low[i] + b * width, min(high[i], low[i] + (b + 1) * width)
            open_[i] = high[i] - low[i] > 1 and above[i] + histogram[i, b] > 8 * k
        state.unpersist()
    last = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, own = shared.value
        best = None
        for some, v in gathered(batches, ROWS_AT_ONCE):
            score = _scores(some, _whole(v, scale), query_ids, own, exact)
            at, row = np.nonzero(score >= last.value[:, None])
            new = pd.DataFrame({"query_id": query_ids[at], "vec_id": some[row], "score": score[at, row]})
            best = _best(new if best is None else pd.concat([best, new]), k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return rows.mapInArrow(keep, "query_id long, vec_id long, score long")
