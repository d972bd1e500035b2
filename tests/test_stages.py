import pytest
from pyspark.sql import functions as F

from seriesmill.sources.stages import GateError, KeyedStage


def rows(spark, items):
    return spark.createDataFrame(items, "id long, n long, text string")


def content(stage):
    return {r["id"]: (r["n"], r["text"]) for r in stage.read().collect()}


def test_a_run_that_ends_before_its_commit_leaves_no_trace(spark, tmp_path):
    stage = KeyedStage(spark, str(tmp_path / "s"), "id", "n", buckets=8)
    assert stage.read() is None
    stage.upsert(rows(spark, [(i, 1, "a") for i in range(40)]))
    first = content(stage)
    stage.write(rows(spark, [(i, 2, "lost") for i in range(20, 60)]))
    assert content(stage) == first
    assert {r["id"] for r in stage.to_fetch(rows(spark, [(i, 0, "") for i in range(60)])).collect()} == {str(i) for i in range(40, 60)}
    stage.upsert(rows(spark, [(i, 2, "b") for i in range(20, 60)]))
    assert content(stage) == {i: (1, "a") if i < 20 else (2, "b") for i in range(60)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    stage = KeyedStage(spark, str(tmp_path / "s"), "id", "n", buckets=8)
    stage.upsert(rows(spark, [(i, 1, "a") for i in range(80)]))
    before = stage.holders()
    assert len(before) == 8
    stage.upsert(rows(spark, [(3, 2, "b"), (3, 5, "c"), (3, 4, "d")]))
    changed = [b for b, run in stage.holders().items() if run != before[b]]
    assert len(changed) == 1 and content(stage)[3] == (5, "c") and len(content(stage)) == 80
    stage.upsert(rows(spark, [(3, 1, "old")]))
    assert content(stage)[3] == (5, "c")


def test_a_gate_that_fails_stops_the_commit(spark, tmp_path):
    stage = KeyedStage(spark, str(tmp_path / "s"), "id", "n")
    gates = {"positive": F.col("n") > 0, "text": F.length("text") < 3}
    stage.upsert(rows(spark, [(1, 1, "a"), (1, 2, "b"), (None, 3, "c")]), gates)
    assert content(stage) == {1: (2, "b"), None: (3, "c")}
    with pytest.raises(GateError, match="positive: 1 rows, text: 2 rows"):
        stage.upsert(rows(spark, [(2, -1, "a"), (3, 1, "long"), (4, 1, None)]), gates)
    assert content(stage) == {1: (2, "b"), None: (3, "c")}
    stage.upsert(rows(spark, []), gates)
    assert len(content(stage)) == 2


def test_new_columns_are_null_in_old_rows(spark, tmp_path):
    stage = KeyedStage(spark, str(tmp_path / "s"), "id", "n", buckets=2)
    stage.upsert(rows(spark, [(i, 1, "a") for i in range(10)]))
    stage.upsert(rows(spark, [(1, 2, "b")]).withColumn("more", F.lit(7)))
    got = {r["id"]: r["more"] for r in stage.read().collect()}
    assert got[1] == 7 and sum(v is None for v in got.values()) == 9
