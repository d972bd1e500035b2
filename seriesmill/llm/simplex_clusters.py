"""Centroid clustering in whole numbers, with an n-simplex projection that spares comparisons.

The distances of a vector to a few pivots are the edges of a simplex over the pivots; its apex has
one coordinate for each further pivot and a height. They are computed once and kept with the
vector. Between two apexes the heights, taken on the same side and on opposite sides of the
pivots' plane, give a lower and an upper bound of the true distance. A centroid whose lower
bound is above the least upper bound of a vector cannot be its nearest; only the others are
compared exactly, in whole numbers. The pivots are centroids of earlier rounds: later centroids
lie near their plane, where the bounds are tight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.vectors import matrix
from seriesmill.sources.tables import written

#: Components up to here are compared in longs, larger ones in whole numbers of any size.
_LONG = 1 << 27
#: Of the squared lengths at hand; far above the rounding of any apex coordinate.
_SLACK = 1e-5
#: A pivot nearer than this share of the farthest to the plane of those before it adds nothing.
_FLAT = 0.02
_ROWS = 4096
#: Rounds after which the centroids of the last two become the pivots.
REFRESH = (2, 5)


class Frame(NamedTuple):
    """Pivots, and the inverse of the triangular matrix of their own apex coordinates."""

    pivots: np.ndarray
    inverse: np.ndarray

    @property
    def base(self) -> float:
        return float(np.square(self.pivots - self.pivots[0]).sum(1).max())


def frame(points: np.ndarray) -> Frame:
    """The pivots among some points: the first, then each one that stands well off the plane of those chosen."""
    points = points.astype(np.float64)
    chosen, rows = [points[0]], np.zeros((0, 0))
    farthest = max(float(np.sqrt(np.square(points - points[0]).sum(1).max())), 1.0)
    for p in points[1:]:
        edges = np.array([p - points[0]]) @ np.array([c - points[0] for c in chosen[1:]]).T if len(chosen) > 1 else np.zeros((1, 0))
        place = np.linalg.solve(rows, edges[0]) if len(rows) else np.zeros(0)
        height = np.square(p - points[0]).sum() - np.square(place).sum()
        if height > (_FLAT * farthest) ** 2:
            rows = np.block([[rows, np.zeros((len(rows), 1))], [place, np.sqrt(height)]])
            chosen.append(p)
    return Frame(np.array(chosen), np.linalg.inv(rows) if len(rows) else rows)


def apexes(own: Frame, rows: np.ndarray) -> np.ndarray:
    """Apex coordinates of rows over the pivots, from their distances alone; the last one is the height."""
    squares = np.stack([np.square(rows - p).sum(1) for p in own.pivots], 1)
    edges = np.square(own.pivots - own.pivots[0]).sum(1)
    place = (squares[:, :1] + edges[1:] - squares[:, 1:]) / 2 @ own.inverse.T
    return np.column_stack([place, np.sqrt(np.maximum(squares[:, 0] - np.square(place).sum(1), 0))])


def candidates(own: Frame, apex: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to each row of apex coordinates."""
    other = apexes(own, centroids)
    flat = np.square(apex[:, None, :-1] - other[None, :, :-1]).sum(2)
    here, there = apex[:, None, -1], other[None, :, -1]
    low, high = flat + np.square(here - there), flat + np.square(here + there)
    size = np.square(apex).sum(1)[:, None] + np.square(other).sum(1)[None] + own.base
    return low - _SLACK * size <= (high + _SLACK * size).min(1, keepdims=True)


def _distances(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.square(rows - centroid).sum(1)


def nearest(rows: np.ndarray, centroids: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each row, compared exactly where ``may`` is true; ties: the smaller number."""
    kind = rows.dtype
    cluster, best = np.zeros(len(rows), np.int64), np.full(len(rows), -1, kind)
    for j, c in enumerate(centroids.astype(kind)):
        at = np.arange(len(rows)) if may is None else np.flatnonzero(may[:, j])
        d = _distances(rows[at], c)
        closer = (best[at] < 0) | (d < best[at])
        cluster[at[closer]], best[at[closer]] = j, d[closer]
    return cluster, best


def whole(v: np.ndarray, scale: int, centroids: np.ndarray | None = None) -> np.ndarray:
    """floor(scale x component): longs where squares of differences fit, else whole numbers of any size."""
    scaled = np.floor(scale * v)
    if not np.isfinite(scaled).all():
        raise ValueError("a component times the scale is no number")
    large = max([abs(scaled).max(initial=0)] + ([max(map(abs, centroids.ravel().tolist()))] if centroids is not None else []))
    return scaled.astype(np.int64) if large < _LONG else np.array([[int(x) for x in r] for r in scaled.tolist()], object).reshape(v.shape)


def _assigned(batches: Iterator[pa.RecordBatch], own: Frame, centroids: np.ndarray, scale: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, clusters, squared distances) of at most 4,096 rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            rows = whole(matrix(part.column("v")), scale, centroids)
            may = candidates(own, matrix(part.column("apex")), centroids.astype(np.float64)) if rows.dtype == np.int64 else None
            yield part.column("id"), rows, *nearest(rows, centroids, may)


def _with_apexes(rows: DataFrame, own: Frame, scale: int) -> DataFrame:
    """The vectors with their apex coordinates, written once for several rounds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                found = apexes(own, np.floor(scale * matrix(part.column("v"))))
                starts = np.arange(len(part) + 1, dtype=np.int32) * found.shape[1]
                column = pa.ListArray.from_arrays(pa.array(starts), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), column], ["id", "v", "apex"])

    return written(rows.select("id", "v").mapInArrow(each, "id long, v array<double>, apex array<double>"), "simplex")


def _moved(rows: DataFrame, own: Frame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Centroids after a round: exact floors of the means. A task sends a row for each cluster and component."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        totals, counts = np.zeros((k, d), object), np.zeros(k, np.int64)
        for _, part, cluster, _ in _assigned(batches, own, centroids, scale):
            for j in np.unique(cluster):
                mine = part[cluster == j]
                totals[j] += mine.sum(0).astype(object)
                counts[j] += len(mine)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(full, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(full))),
                pa.array(totals[full].ravel().tolist(), pa.decimal128(38, 0)), pa.array(np.repeat(counts[full], d)),
            ],
            ["cluster", "place", "total", "n"],
        )

    parts = rows.mapInArrow(each, "cluster int, place int, total decimal(38,0), n long")
    sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each cluster and component
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def _kept(df: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """``id`` and ``v`` of vectors of ``width`` finite components."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.filter((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3,
    id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each vector kept.

    Kept are vectors of exactly ``width`` components, none null or non-finite; a vector is
    floor(``scale`` x component). Centroids start as the k kept rows with the smallest SHA-256 of
    ``seed:id`` (fewer rows: fewer centroids); rows that repeat an id are ordered by their
    components, and rows without an id come last and are clustered like any other. Each round
    assigns every row to its nearest centroid and moves every centroid that has rows to the floor
    of their mean; the result is one more assignment. Equal rows are rows each. An empty table
    gives an empty result. Components may be of any size, but a distance or sum that
    doesn't fit in a long is an error.
    """
    spark = df.sparkSession
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = _kept(df, id_col, vector, width)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("key", key).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], names)
    centroids = np.array([[int(x) for x in row] for row in np.floor(scale * np.array([r["v"] for r in first])).tolist()], object)
    earlier, own, ready = centroids, None, rows
    for done in range(rounds):
        if done == 0 or done in REFRESH:
            own = frame(np.concatenate([centroids, earlier] if done else [centroids]).astype(np.float64))
            ready = _with_apexes(ready, own, scale)
        moved = _moved(ready, own, centroids, scale)
        if (moved == centroids).all():  # the rounds left would change nothing
            break
        earlier, centroids = centroids, moved
    if own is None:
        own = frame(centroids.astype(np.float64))
        ready = _with_apexes(rows, own, scale)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in _assigned(batches, own, centroids, scale):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    found = written(ready.mapInArrow(each, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), digest) for j, digest in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
