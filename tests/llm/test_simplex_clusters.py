"""N-simplex clustering against plain rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from seriesmill.llm import simplex_clusters as sc
from seriesmill.llm.queries import op13

DDL = "vec_id long, embedding array<double>, cluster int, apex string, v long"


def brute(rows, k=8, rounds=10, scale=1024, width=64):
    def fine(v):
        return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * x) if abs(x) < 1e15 else scale * int(x) for x in v]) for i, v in rows if fine(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    inner = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inner[c], total, digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 7, "x", 9) for i, v in rows], DDL).repartition(3)
    return sorted(map(tuple, sc.cluster(df, **k).collect()), key=str)


def near(r, centre, width, spread):
    return [c + r.gauss(0, spread) for c in centre[:width]]


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_rounds_are_the_plain_ones(spark, spread):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, near(r, centres[i % 5], 6, spread)) for i in range(160)]
    assert run(spark, rows, k=5, rounds=8, width=6) == brute(rows, k=5, rounds=8, width=6)


def test_ties_repeated_rows_and_ids(spark):
    r = random.Random(5)
    rows = [(i % 9, [float(r.randint(-1, 1)) for _ in range(3)]) for i in range(60)]
    rows += [(3, [0.0, 0.0, 0.0])] * 30 + [(None, [1.0, 1.0, -1.0])] * 2
    assert run(spark, rows, k=4, rounds=6, width=3) == brute(rows, k=4, rounds=6, width=3)
    same = [(i, [0.5, 0.25, 0.0]) for i in range(12)]  # every centroid is the same vector
    assert run(spark, same, k=4, rounds=3, width=3) == brute(same, k=4, rounds=3, width=3)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [0.0, -inf, 0.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0, 4.0])]
    assert run(spark, rows, width=3) == []
    assert run(spark, [], width=3) == []
    two = [*rows, (8, [1.0, 2.0, 3.0]), (9, [-0.0001, 2.0, 3.0])]
    assert run(spark, two, width=3) == brute(two, width=3)  # fewer rows than centroids


def test_large_components(spark):
    rows = [(i, [float(i * 10**5), -1e5 * i, 0.1]) for i in range(20)] + [(30, [2e5, 3.3, 1e6])]
    assert run(spark, rows, k=3, rounds=5, width=3) == brute(rows, k=3, rounds=5, width=3)
    with pytest.raises(Exception, match="[Oo]verflow|too large|out of|not fit"):
        run(spark, [(1, [1e200, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [5.0, 0.0, 0.0])], k=1, rounds=1, width=3)


def test_no_rounds_and_one_centroid(spark):
    rows = [(i, [float(i), 1.0]) for i in range(7)]
    assert run(spark, rows, k=2, rounds=0, width=2) == brute(rows, k=2, rounds=0, width=2)
    assert run(spark, rows, k=1, rounds=3, width=2) == brute(rows, k=1, rounds=3, width=2)


def test_bounds_hold_and_spare_most_comparisons():
    r = np.random.default_rng(3)
    rows = np.floor(1024 * r.normal(size=(3000, 64)) / 8)
    centroids = np.stack([rows[i::8].mean(0) + 40 * r.normal(size=64) for i in range(8)])
    own = sc.frame(np.concatenate([np.floor(centroids), rows[:4]]))
    may = sc.candidates(own, sc.apexes(own, rows), np.floor(centroids + r.normal(size=centroids.shape)))
    exact = np.square(rows[:, None] - np.floor(centroids)).sum(2)
    assert may.mean() < 0.5
    near_ones = exact <= exact.min(1, keepdims=True)
    same = sc.candidates(own, sc.apexes(own, rows), np.floor(centroids))
    assert same[near_ones].all()


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op13(spark, sf).collect()), key=str) == brute(rows)
