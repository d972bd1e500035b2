"""From raw documents to packed training sequences: the stages and the run over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import language_id, packing, quality, simhash
from seriesmill.llm.queries import QUALITY_BAR, TOKENIZER, fold, small_batches, table
from seriesmill.llm.text import fresh
from seriesmill.session import scratch_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or with no likely language, go."""
    small_batches(spark)
    model = language_id.fit(docs, where=fold("doc_id", 3) != 1)
    lang, score = fresh("__lang", docs.columns), fresh("__score", docs.columns)
    found = language_id.predict(docs, model, keep=docs.columns, names=(lang, score))
    kept = found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= 0.5))
    return kept.drop(lang, score)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the model learns from the labels of the documents left."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), where=fold("doc_id", 4) != 2)
    score = fresh("__score", docs.columns)
    scored = quality.score(docs, model, keep=docs.columns, name=score)
    return scored.filter(F.col(score) >= QUALITY_BAR).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; one row of it, should rows repeat."""
    small_batches(spark)
    return simhash.without_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in training sequences."""
    small_batches(spark)
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("simhash", one_of_each_group),
    ("packing", packed),
]

#: Trained models, fingerprints and a tokenizer have no counterpart in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each writes a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_table(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
