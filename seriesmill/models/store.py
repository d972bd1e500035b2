"""Fitted folds kept in the shared folder: what was learned once is loaded by whoever asks again.

A fold is kept under a name made of the way it was fitted, its features and a digest of its training
rows that does not depend on their order. The table of its numbers is written last, so a fold whose
writing was cut short is fitted anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml.classification import (
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.models.fit import BiasedScaler, FittedFold
from seriesmill.models.preprocess import MedianImputer, StandardScaler
from seriesmill.session import exists

MODELS = {
    m.__name__: m for m in (LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel)
}
SCALERS = {s.__name__: s for s in (StandardScaler, BiasedScaler)}
Fit = Callable[[DataFrame, list[str], str], FittedFold]


def digest(train: DataFrame, features: list[str]) -> str:
    """Of the rows' features and targets, in any order: their number and sums of two hashes."""
    cells = [F.col(f"`{f}`").cast("double") for f in features] + [F.col("target").cast("double")]
    total = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    row = train.agg(F.count(F.lit(1)), *total).first()
    return hashlib.sha256(json.dumps([*map(str, row), features]).encode()).hexdigest()


def save(spark: SparkSession, fitted: FittedFold, path: str) -> None:
    fitted.model.write().overwrite().save(f"{path}/model")
    fitted.saved = f"{path}/model"
    numbers = {
        "fold": fitted.fold,
        "features": fitted.features,
        "asked": fitted.imputer.features,
        "medians": fitted.imputer.medians,
        "scaler": type(fitted.scaler).__name__ if fitted.scaler else None,
        "moments": fitted.scaler.moments if fitted.scaler else None,
        "history": fitted.history,
        "model": type(fitted.model).__name__,
    }
    spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> FittedFold | None:
    """The fold kept at ``path``; none if it is not there as a whole."""
    if not exists(spark, f"{path}/numbers/_SUCCESS"):
        return None
    row = spark.read.schema("numbers string").parquet(f"{path}/numbers").first()
    if row is None:
        return None
    n = json.loads(row["numbers"])
    scaler = SCALERS[n["scaler"]]({f: tuple(m) for f, m in n["moments"].items()}) if n["scaler"] else None
    model = MODELS[n["model"]].load(f"{path}/model")
    return FittedFold(n["fold"], MedianImputer(n["medians"], n["asked"]), scaler, n["features"], model, n["history"], f"{path}/model")


def kept(fit: Fit, folder: str, name: str) -> Fit:
    """``fit`` that looks in ``folder`` first; ``name`` stands for the way of fitting and its parameters."""

    def fit_or_load(train: DataFrame, features: list[str], fold: str) -> FittedFold:
        spark = train.sparkSession
        path = f"{folder}/{name}-{fold}-{digest(train, features)}"
        found = load(spark, path)
        if found is None:
            found = fit(train, features, fold)
            save(spark, found, path)
        return found

    return fit_or_load
