"""The pipeline on a small table, stage by stage against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmill.llm.queries import TOKENIZER
from seriesmill.session import scratch_table


@pytest.fixture(scope="module")
def folder(spark):
    r = np.random.default_rng(1)
    english, french = "the cat and this thing with that of".split(), "le chat être où même une des les".split()
    rows = []
    for i in range(240):
        words = r.choice(french if i % 4 == 0 else english, 40 + i % 30)
        text = " ".join(f"{w.upper()}!!" for w in words) if i % 5 == 0 else " ".join(words)
        rows.append((i, text, "fr" if i % 4 == 0 else "en", "s", len(text), 1.0))
    rows += [(300 + i, rows[1][1], "en", "s", 0, 0.0) for i in range(50)]  # copies
    rows += [(400, None, None, None, None, None), (401, "", "en", "s", 0, 0.0), (402, "12 34 !!", "en", "s", 0, 0.0), (1, rows[1][1], "en", "s", 0, 0.0)]
    path = scratch_table(spark, "test-tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language_id", "quality", "simhash", "packing"]
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {400, 401, 402}
    good = stages["quality"](spark, known, folder)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {i for i in range(240) if i % 5} | set(range(300, 350))
    single = stages["simhash"](spark, good, folder)
    assert single.columns == columns
    kept = [r.doc_id for r in single.collect()]
    assert kept.count(1) == 1 and not set(kept) & set(range(300, 350)) and len(kept) == len(set(kept))
    packed = stages["packing"](spark, single, folder).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_stages_with_odd_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = {c: F.lit(i) for i, c in enumerate(["__text", "__LANG", "__score", "__fp", "__fp_", "__id", "__row", "n", "fp", "id", "component", "piece"])}
    odd |= {"tags": F.create_map(F.lit("a"), F.col("doc_id")), "dotted.name": F.lit("x")}
    docs = docs.withColumns({c: x for c, x in odd.items() if c != "dotted.name"}).withColumn("dotted.name", odd["dotted.name"])
    columns, plain = docs.columns, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = stage(spark, docs, folder), stage(spark, plain, folder)
        if name != "packing":
            assert docs.columns == columns
        assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())


def test_run_is_all_stages(spark, folder):
    got = {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert got == {(r.doc_id, r.piece, r.length) for r in docs.collect()}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert TOKENIZER
