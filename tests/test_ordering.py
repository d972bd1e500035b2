import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import ordering as o
from seriesmill.plans import queries_ingest


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(o, "PIECE_ROWS", 16)
    monkeypatch.setattr(o, "SAMPLES", 4)


def largest_piece(made):
    return made.df.groupBy(*made.parts).count().agg(F.max("count")).first()[0]


def keyed(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "b", None]), rng.choice([0, 0, 0, 61, 61_000_001, None]), i) for i in range(400)]
    rows += [("few", 5, 900 + i) for i in range(3)]
    return rows, spark.createDataFrame(rows, "k string, s long, id long").withColumn("ts", F.timestamp_micros("s")).repartition(5)


def in_order(rows, k):
    return sorted([r for r in rows if r[0] == k], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("cut_up", [False, True])
def test_position_previous_and_total(spark, cut_up, monkeypatch):
    if cut_up:
        monkeypatch.setattr(o, "PIECE_ROWS", 16)
        monkeypatch.setattr(o, "SAMPLES", 4)
    rows, df = keyed(spark)
    made = o.cut(df, ["k"], ["ts", "id"])
    assert made.large == cut_up
    made = o.running_total(o.previous(o.position(made, "n"), ["id", "ts"], "p"), "id", "t")
    got = {r["id"]: r for r in made.plain().collect()}
    assert len(got) == len(rows)
    for k in ["a", "b", "few", None]:
        total, last = 0, None
        for n, row in enumerate(in_order(rows, k), 1):
            total += row[2]
            r = got[row[2]]
            assert (r["n"], r["t"], r["p"] and r["p"]["id"]) == (n, total, last)
            last = row[2]


def test_global_position(spark, small):
    df = spark.range(1000).withColumn("ts", F.timestamp_seconds(F.col("id") * 37 % 500))
    got = o.with_position(df, [], ["ts", "id"], "n").collect()
    order = sorted(range(1000), key=lambda i: (i * 37 % 500, i))
    assert {r["id"]: r["n"] for r in got} == {i: n for n, i in enumerate(order, 1)}
    assert o.with_position(df.filter("false"), [], ["id"], "n").collect() == []


def test_descending_numbers(spark, small):
    df = spark.range(300).withColumn("v", F.col("id") / 7.0)
    got = {r["id"]: r["n"] for r in o.with_position(df, [], [-F.col("v")], "n").collect()}
    assert got == {i: 300 - i for i in range(300)}


CROWDS = {
    "one timestamp": lambda: F.col("id"),
    "scattered 64-bit ids": lambda: F.xxhash64("id"),
    "texts with a long common start": lambda: F.format_string("the-same-twenty-chars%08d", F.col("id")),
    "scores within a millionth": lambda: F.lit(0.5) + F.col("id") * 5e-12,
}


@pytest.mark.parametrize("what", CROWDS)
def test_a_crowded_key_is_cut_evenly(spark, monkeypatch, what):
    monkeypatch.setattr(o, "PIECE_ROWS", 8192)
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("i"), F.timestamp_seconds(F.lit(60)).alias("ts"), CROWDS[what]().alias("id"), F.lit("k").alias("k"), F.lit(1).alias("one"))
    made = o.cut(df, ["k"], ["ts", "id"])
    assert largest_piece(made) <= 3 * o.PIECE_ROWS
    out = o.running_total(o.previous(o.position(made, "n"), ["i"], "p"), "one", "t").plain()
    assert out.filter("n <> t").count() == 0
    assert out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (n, 1, n)
    right = out.select("n", "id").alias("a").join(out.select((F.col("n") + 1).alias("n"), F.col("id").alias("before")), "n").filter("before >= id")
    assert right.count() == 0
    if what != "scattered 64-bit ids":
        assert out.filter("p.i is distinct from nullif(i, 0) - 1").count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {
        "mixed": np.concatenate([rng.normal(0, 1e3, 301), [0.0] * 200, rng.normal(0, 1e-6, 50)]),
        "one": np.array([-2.5]),
        "same": np.array([7.0] * 40),
        "wide": np.array([-1e12, -3.0, 0.0, 4.0, 1e12, 2e12]),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("mixed", None), ("none", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    got = o.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()
    assert len(got) == len(data) * len(probs)
    for r in got:
        assert np.isclose(r["quantile"], np.quantile(data[r["k"]], r["prob"]), rtol=1e-12)


@pytest.mark.parametrize("accuracy,rows_inside", [(100, 500), (50, 40), (20, 4)])
def test_quantiles_from_narrow_brackets(spark, monkeypatch, accuracy, rows_inside):
    monkeypatch.setattr(o, "ACCURACY", accuracy)
    monkeypatch.setattr(o, "BRACKET_ROWS", rows_inside)
    monkeypatch.setattr(o, "GRID", 8)
    rng = np.random.default_rng(accuracy)
    data = {
        "spread": rng.normal(0, 5, 6000),
        "ties": np.concatenate([np.full(2500, 1.0), np.full(2500, 2.0), rng.uniform(0, 3, 800)]),
        "same": np.full(3000, -4.0),
        "two": np.array([0.0] * 1999 + [1.0] * 2001),
        "few": rng.normal(0, 1, 7),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(None, 3.0), (None, 4.0)] * 300
    data[None] = np.array([3.0, 4.0] * 300)
    probs = [0.0, 0.2, 0.5, 0.8, 1.0]
    got = o.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", probs).collect()
    assert len(got) == len(data) * len(probs)
    for r in got:
        assert np.isclose(r["quantile"], np.quantile(data[r["k"]], r["prob"]), rtol=1e-12), (r, accuracy)


def test_quantiles_without_key(spark):
    got = o.exact_quantiles(spark.range(11).withColumn("v", F.col("id") * 1.0), [], "v", [0.25]).collect()
    assert [(r["prob"], r["quantile"]) for r in got] == [(0.25, 2.5)]


def test_positions_of_text_ids(spark, small):
    from seriesmill.evaluation.bootstrap import fold_positions

    ids = [f"O{1 + i % 3}_{i:04d}" for i in range(500)]
    df = spark.createDataFrame([("f", i) for i in ids], "fold string, id string")
    assert [r["position"] for r in fold_positions(df).orderBy("id").collect()] == list(range(500))


def test_rows_of_a_file_are_numbered_in_pieces(spark, tmp_path, monkeypatch):
    """A file of many rows is numbered by many tasks, each with a part of them, and no row is lost."""
    lines = spark.range(6_000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") % 50).alias("l_suppkey"),
        (F.col("id") % 9).cast("double").alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    pieces = []
    monkeypatch.setattr(o, "PIECE_ROWS", 256)
    monkeypatch.setattr(o, "position", lambda made, *a, was=o.position: pieces.append(made) or was(made, *a))
    rows = queries_ingest._filed(spark, str(tmp_path))
    got = rows.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("row").alias("d"), F.max("row").alias("m")).collect()
    assert sorted((r["file"], r["n"], r["d"], r["m"]) for r in got) == [(f, 2000, 2000, 2000) for f in range(3)]
    assert dict(rows.dtypes)["row"] == "int"
    sizes = [r["count"] for r in pieces[0].df.groupBy(*pieces[0].parts).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 1024
