"""Approximate nearest neighbours by collision counting over sorted single projections.

Inner products become distances: a vector is divided by the largest norm M of its shard and
gets the component that makes its length 1, a query is scaled to length 1 and gets 0; then the
nearest point has the largest inner product. A shard holds vectors of similar norms, or so few
that all of them are verified: vectors of other lengths move nothing. Each of ``m`` random directions is one hash
function: a shard of the table keeps its vectors' projections sorted, with their places.

A query opens a small window around its own projection in every sorted array. Vectors inside
collide with it; members of small windows are walked, in wide ones a vector's place is compared
with the window's ends. Vectors with at least ``threshold`` collisions are verified: their inner
product is worked out on the original vectors. Virtual rehashing widens the windows to the
radius at which a vector better than the k-th best known is unlikely (``SURE`` standard
deviations) to lack collisions. The k-th best known goes along from shard to shard within a
task; it starts with that of a sample of ``FIRST`` vectors, so shards that hold nothing near
take narrow windows, and none at all where no vector is long enough.

Shards have a bounded size and every vector is in one; queries come in blocks of bounded size,
each broadcast and searched in all shards; a shard hands over k vectors for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.vectors import finite, gathered, matrix
from seriesmill.sources.tables import written

SHARD = 8192  # places fit in 16 bits
QUERY_BLOCK = 4096
SEED = 20
RATIO = 1.1  # of the norms in a shard
SURE = 2.0
FIRST = 8192  # vectors of the sample: a bound for every query, whatever the size of the table
START = 0.04  # first radius
WALK = 32  # windows that hold less than one part in so many are walked


def directions(d: int, m: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, m))


class Shard:
    """Sorted projections of some vectors, and each vector's place in each sorted array."""

    def __init__(self, v: np.ndarray, largest: float, m: int) -> None:
        scaled = v / largest
        last = np.sqrt(np.maximum(1.0 - (scaled * scaled).sum(1), 0.0))
        found = np.concatenate([scaled, last[:, None]], axis=1) @ directions(v.shape[1] + 1, m)
        order = np.argsort(found, axis=0, kind="stable").T
        self.values = np.take_along_axis(found.T, order, axis=1)
        self.places = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.places, order, np.arange(len(v), dtype=np.uint16)[None, :], axis=1)


def windows(values: np.ndarray, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of places (queries x directions) of each window; ``half`` is a width for each query."""
    low = np.empty(centres.shape, np.int64)
    high = np.empty_like(low)
    for j, own in enumerate(values):
        low[:, j] = np.searchsorted(own, centres[:, j] - half)
        high[:, j] = np.searchsorted(own, centres[:, j] + half, side="right")
    return low, high - low


def collisions(places: np.ndarray, order: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """In how many windows each vector is: by the members of small windows, else by each vector's places."""
    n = places.shape[1]
    if WALK * int(size.sum()) < places.size:
        members = [own[a : a + k] for own, a, k in zip(order, low.tolist(), size.tolist(), strict=True)]
        return np.bincount(np.concatenate(members), minlength=n)
    # Unsigned: places before a window wrap around to large numbers.
    low, size = (np.minimum(x, 65_535).astype(np.uint16)[:, None] for x in (low, size))
    count = np.empty(n, np.uint8)
    for at in range(0, n, 512):  # what is worked on stays in a core's cache
        inside = places[:, at : at + 512] - low < size
        count[at : at + 512] = inside.view(np.uint8).sum(0, dtype=np.uint8)
    return count


def spread(m: int, threshold: int) -> float:
    """Half-width, for vectors at distance 1, that gives ``threshold`` collisions with near certainty."""
    low, high = 0.0, 1.0
    for _ in range(50):  # the chance of one collision that leaves SURE deviations above the threshold
        p = (low + high) / 2
        low, high = (low, p) if m * p - SURE * (m * p * (1 - p)) ** 0.5 >= threshold else (p, high)
    return NormalDist().inv_cdf((1 + min(high, 1 - 1e-9)) / 2)


def search(
    ids: np.ndarray, v: np.ndarray, places: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray,
    threshold: int, spare: int, largest: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and the ids and scores of the best verified vectors of the shard.

    ``known`` (queries x k, ascending) are the best scores so far; those found here go in.
    """
    (n, d), m, k = v.shape, len(values), known.shape[1]
    length = np.sqrt((queries * queries).sum(1))

    def verified(q: int, near: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        near = near[ids[near] != query_ids[q]]
        rough = v[near] @ queries[q]  # may differ from the score in the last digits
        if len(near) > k:
            near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9 * largest * length[q]]
        score = (v[near] * queries[q]).sum(1)
        best = np.lexsort((ids[near], -score))[:k]
        return q, ids[near][best], score[best]

    def learn(q: int, score: np.ndarray) -> None:
        known[q] = np.sort(np.concatenate([known[q], score]))[-k:]

    def apart(some: np.ndarray) -> np.ndarray:
        """Distance of a vector as good as the k-th best; below 0 where no vector here can be."""
        cosine = known[some, 0] / (largest * length[some])
        return np.where(cosine > 1 + 1e-9, -1.0, np.sqrt(np.maximum(2 - 2 * np.maximum(cosine, -1.0), 0.0)))

    if n <= spare * k:
        for q in np.flatnonzero(apart(np.arange(len(queries))) >= 0).tolist():
            hit = verified(q, np.arange(n))
            learn(q, hit[2])
            yield hit
        return
    order = np.empty(places.shape, np.int64)
    np.put_along_axis(order, places.astype(np.int64), np.arange(n)[None, :], axis=1)
    unit = np.concatenate([queries / length[:, None], np.zeros((len(queries), 1))], axis=1)
    centres, width = unit @ directions(d + 1, m), spread(m, threshold)
    for at in range(0, len(queries), 1024):
        some = np.arange(at, min(at + 1024, len(queries)))
        some = some[apart(some) >= 0]
        seen: dict[int, np.ndarray] = {}
        radius = np.full(len(some), START)
        for last in (False, True):
            # 1e-6: equal vectors whose projections differ in the last digits
            low, size = windows(values, centres[some], radius * width + 1e-6)
            for i, q in enumerate(some.tolist()):
                if not last and WALK * int(size[i].sum()) >= places.size:
                    continue
                near = np.flatnonzero(collisions(places, order, low[i], size[i]) >= threshold)
                if last and q in seen:
                    near = near[~np.isin(near, seen[q])]
                elif not last:
                    seen[q] = near
                hit = verified(q, near)
                learn(q, hit[2])
                yield hit
            radius = apart(some)
            wider = (radius > START) | [q not in seen and r >= 0 for q, r in zip(some.tolist(), radius, strict=True)]
            some, radius = some[wider], radius[wider]


def alike(v: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, float]]:
    """Places of vectors whose norms differ by ``RATIO`` at most, or of up to ``least`` vectors; and their largest norm."""
    norm = np.sqrt((v * v).sum(1))
    order = np.argsort(norm, kind="stable")
    norm, end = norm[order], len(v)
    while end:  # the long ones first
        start = min(int(np.searchsorted(norm, norm[end - 1] / RATIO)), max(0, end - least))
        yield order[start:end], max(float(norm[end - 1]), 1e-150)  # squares of smaller ones are 0
        end = start


def build(rows: DataFrame, m: int, least: int) -> DataFrame:
    """The index: one row for each shard, every vector in one of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in gathered(batches, SHARD):
            for own, largest in alike(v, least):
                shard = Shard(v[own], largest, m)
                parts = [ids[own].astype("<i8"), v[own].astype("<f8"), shard.places, shard.values]
                columns = [pa.array([len(own)], pa.int64()), pa.array([largest]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
                yield pa.RecordBatch.from_arrays(columns, ["n", "largest", "ids", "v", "places", "values"])

    square = F.aggregate("v", F.lit(0.0), lambda sofar, x: sofar + x * x)
    by_norm = rows.sortWithinPartitions(square.desc())
    return by_norm.mapInArrow(each, "n long, largest double, ids binary, v binary, places binary, values binary")


def bounded(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``queries`` plus ``bound``: the k-th best score among a sample of ``FIRST`` vectors, which the search can only better."""
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(FIRST).toArrow()
    ids, v = sample["id"].to_numpy(), matrix(sample["v"].combine_chunks()) if len(sample) else None
    shared = queries.sparkSession.sparkContext.broadcast((ids, v))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = shared.value
        for own, q in gathered(batches, 512):
            score = q @ v.T
            score[own[:, None] == ids[None, :]] = -np.inf
            bound = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(own), -np.inf)
            bound -= 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))  # a product of matrices rounds in another order
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(bound)], ["id", "v", "bound"]
            )

    return queries.mapInArrow(each, "id long, v array<double>, bound double")


def searched(index: DataFrame, queries: DataFrame, k: int, m: int, threshold: int, spare: int) -> DataFrame:
    """The k best of all shards for each query, which come in blocks."""
    spark = index.sparkSession
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = []
    for b in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # a block
        if not len(table):
            continue
        shared = spark.sparkContext.broadcast((table["id"].to_numpy(), matrix(table["v"].combine_chunks()), table["bound"].to_numpy()))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, own, bound = shared.value
            known = np.repeat(bound[:, None], k, axis=1)
            for batch in batches:
                for row in range(len(batch)):
                    n, largest, *parts = (batch.column(c)[row].as_py() for c in ("n", "largest", "ids", "v", "places", "values"))
                    kinds = ("<i8", "<f8", np.uint16, np.float64)
                    ids, v, places, values = (np.frombuffer(p, t) for p, t in zip(parts, kinds, strict=True))
                    args = (ids, v.reshape(n, -1), places.reshape(m, n), values.reshape(m, n), query_ids, own, known)
                    hits = [*search(*args, threshold, spare, largest)]
                    if not hits:
                        continue
                    at = np.repeat([q for q, _, _ in hits], [len(i) for _, i, _ in hits])
                    yield pa.RecordBatch.from_pydict(
                        {"query_id": query_ids[at], "vec_id": np.concatenate([i for _, i, _ in hits]), "score": np.concatenate([s for _, _, s in hits])}
                    )

        found.append(index.mapInArrow(each, "query_id long, vec_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(place))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", m: int = 128, threshold: int = 84,
    spare: int = 15,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest inner products found for each query.

    ``is_query`` is a condition on the columns of ``df``. Vectors that are null, zero or hold a
    null or non-finite component, and rows without an id, take no part. Rows that repeat a
    query's id are one query (the least vector) and no candidates of it; other repeated rows
    are candidates each. Ties go to the smaller id. Vectors of different lengths are an error.
    Shards of up to ``spare`` x k vectors are verified whole.
    """
    if m > 255:
        raise ValueError("collisions of a vector are counted in a byte")
    if m > 255:
        raise ValueError("collisions of a vector are counted in a byte")
    rows = finite(df, id_col, vector).filter(F.exists("v", lambda x: x != 0))
    queries = finite(df.filter(is_query), id_col, vector).filter(F.exists("v", lambda x: x != 0))
    queries = written(bounded(queries.groupBy("id").agg(F.min("v").alias("v")), rows, k), "ann-queries")
    index = written(build(rows, m, spare * k), "ann-index")
    found = written(searched(index, queries, k, m, threshold, spare), "ann-found")
    # Near vectors may lack collisions: queries that are left with too few compare all that could be better.
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(queries.join(enough, "id", "left_anti"), "ann-short")
    again = searched(index, short, k, m, 0, spare)
    once = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return once.unionByName(again).select("query_id", "rank", "vec_id", "score")
