"""Three classifiers on MLlib, and the loop over temporal folds.

Only folds are looped over on the driver, one by one or side by side; every step of a fold is a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.evaluation.metrics import with_decisions
from seriesmill.models import forest
from seriesmill.models.preprocess import (
    MedianImputer,
    StandardScaler,
    fit_median_imputer,
    fit_standard_scaler,
)
from seriesmill.session import scratch_table

BIAS = "__bias"
#: Rows of a task of a fit at most, about; and rows of a task below which more cores do not help.
TASK_ROWS, LEAST_ROWS = 100_000, 10_000


def dealt(rows: DataFrame, n: int, whole: bool = False) -> DataFrame:
    """``n`` rows over enough tasks. A table of few different values is small on disk and so read by few tasks, and
    each step of a fit would run on these. Up to ``LEAST_ROWS`` rows stay as they are. With ``whole`` more tasks than
    cores become a multiple of the cores, for fits of many steps: a few tasks left over would hold up each step."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // TASK_ROWS), min(2 * cores, -(-n // LEAST_ROWS)))
    if whole and tasks > cores:
        tasks = -(-tasks // cores) * cores
    return rows.repartition(tasks) if tasks > 1 else rows


@dataclass
class FittedFold:
    """What was learned on one fold's training rows."""

    fold: str
    imputer: MedianImputer
    scaler: StandardScaler | None
    features: list[str]
    model: object = field(repr=False)
    #: Loss after each step of the optimiser, where there is one.
    history: list[float] | None = None
    #: Where the model is written, if it is.
    saved: str | None = None

    def columns(self, df: DataFrame) -> DataFrame:
        """Imputed and scaled feature columns, and the constant one."""
        out = self.imputer.transform(df)
        if self.scaler:
            out = self.scaler.transform(out)
        return out.withColumn(BIAS, F.lit(1.0)).withColumn("target", F.col("target").cast("double"))

    def vectors(self, df: DataFrame) -> DataFrame:
        inputs = self.features + ([BIAS] if isinstance(self.scaler, BiasedScaler) else [])
        return VectorAssembler(inputCols=inputs, outputCol="features_vector").transform(df)

    def prepare(self, df: DataFrame) -> DataFrame:
        return self.vectors(self.columns(df))

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        if isinstance(self.model, RandomForestClassificationModel) and self.model.numClasses == 2:
            if self.saved is None:
                self.saved = scratch_table(df.sparkSession, "forest")
                self.model.write().save(self.saved)
            scored, probability = forest.scored(self.columns(df), self.features, keep, forest.saved_nodes(df.sparkSession, self.saved)), F.col("probability")
        else:
            scored = self.model.transform(self.prepare(df))
            probability = vector_to_array("probability")[1].alias("probability")
        return with_decisions(scored.select(*keep, F.col("target").cast("int").alias("target"), F.lit(self.fold).alias("fold"), probability))


def _history(model: object) -> list[float]:
    summary = model.summary() if callable(model.summary) else model.summary
    return [float(loss) for loss in summary.objectiveHistory]


def _alone(model: object) -> object:
    """The model without its training summary, which holds on to the training rows and the session."""
    model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


class BiasedScaler(StandardScaler):
    """A scaler whose model carries its intercept as one more weight."""


def _learn(train: DataFrame, features: list[str], fold: str, scale: str) -> FittedFold:
    imputer = fit_median_imputer(train, features)
    scaler = None
    if scale != "none":
        scaler = fit_standard_scaler(imputer.transform(train), imputer.kept)
        if scale == "biased":
            scaler = BiasedScaler(scaler.moments)
    return FittedFold(fold, imputer, scaler, imputer.kept, None)


def _mirrored(train: DataFrame, features: list[str], n: int) -> DataFrame:
    """The same mean loss with a constant feature that varies.

    MLlib fixes the weight of a feature without variance at 0, also that of the constant
    one. A row and its mirror image (features negated, target flipped) have the same loss
    at any weights. Of few rows each goes in with its mirror image, of many every other one
    is replaced by it, which leaves the loss as it is and does not double the rows.
    """
    if n > LEAST_ROWS:
        turn = (F.monotonically_increasing_id() + F.spark_partition_id()) % 2
        out = train.withColumn("__sign", F.when(turn == 0, 1).otherwise(-1))
    else:
        out = train.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("__sign"))
    sign = F.col("__sign")
    flipped = {c: F.col(f"`{c}`") * sign for c in [*features, BIAS]}
    return out.withColumns(flipped | {"target": F.when(sign > 0, F.col("target")).otherwise(1 - F.col("target"))})


def fit_logistic(train: DataFrame, features: list[str], fold: str, c: float = 1.0, max_iter: int = 500) -> FittedFold:
    """L2 logistic regression that penalises the intercept too.

    Minimising  |w|^2 / 2 + C * sum(loss)  is the same as  mean(loss) + |w|^2 / (2 C n).
    The intercept is the weight of a constant feature, hence ``fitIntercept=False``.
    """
    fitted = _learn(train, features, fold, "biased")
    n = train.count()
    mirrored = _mirrored(fitted.columns(dealt(train, n)), fitted.features, n)
    fitted.model = LogisticRegression(
        featuresCol="features_vector",
        labelCol="target",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=False,
        maxIter=max_iter,
        tol=1e-10,
    ).fit(fitted.vectors(mirrored).select("features_vector", "target"))
    fitted.history = _history(fitted.model)
    _alone(fitted.model)
    return fitted


def fit_forest(
    train: DataFrame,
    features: list[str],
    fold: str,
    trees: int = 1000,
    depth: int = 4,
    min_leaf: int = 2,
    bins: int = 128,
    seed: int = 42,
) -> FittedFold:
    """Random forest: shallow trees, square root of the features at each split.

    Two rows per leaf already imply four per split. Splits are chosen among ``bins``
    quantile bins; a feature with fewer distinct values is split exactly. On more than
    ``LEAST_ROWS`` rows the trees are grown by ``forest``, which goes about the same work in another order.
    """
    fitted = _learn(train, features, fold, "none")
    classifier = RandomForestClassifier(
        featuresCol="features_vector",
        labelCol="target",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=str(max(1, int(len(fitted.features) ** 0.5))),
        maxBins=bins,
        seed=seed,
    )
    n = train.count()
    if n > LEAST_ROWS:
        fitted.model = forest.grow(fitted.columns(train), n, fitted.features, classifier)
        return fitted
    fitted.model = classifier.fit(fitted.prepare(dealt(train, n)).select("features_vector", "target"))
    _alone(fitted.model)
    return fitted


def fit_mlp(
    train: DataFrame, features: list[str], fold: str, hidden: int = 8, max_iter: int = 200, seed: int = 42
) -> FittedFold:
    """One small hidden layer. An approximation by design: MLlib has sigmoid units and
    L-BFGS, no weight decay and no early stopping on a validation share."""
    fitted = _learn(train, features, fold, "plain")
    fitted.model = MultilayerPerceptronClassifier(
        featuresCol="features_vector",
        labelCol="target",
        layers=[len(fitted.features), hidden, 2],
        maxIter=max_iter,
        seed=seed,
    ).fit(fitted.prepare(dealt(train, train.count(), whole=True)).select("features_vector", "target"))
    fitted.history = _history(fitted.model)
    _alone(fitted.model)
    return fitted


Fit = Callable[[DataFrame, list[str], str], FittedFold]


def run_temporal_folds(
    df: DataFrame, features: list[str], folds: int, fit: Fit, keep: list[str], at_once: int = 1
) -> tuple[DataFrame, list[FittedFold]]:
    """Fit on each fold's train rows, score its test rows; an empty fold is an error.

    ``df`` has a 0/1 ``target`` (undecided rows are left out) and fold<k>_role columns. ``at_once`` folds are
    fitted side by side: between the short jobs of a fit of many steps the cores work on another fold.
    """
    known = df.filter(F.col("target").isNotNull())
    roles = {
        f"{r}{k}": F.count_if(F.col(f"fold{k}_role") == r) for k in range(1, folds + 1) for r in ("train", "test")
    }
    counts = known.agg(*[c.alias(n) for n, c in roles.items()]).first().asDict()
    empty = [n for n, v in counts.items() if not v]
    if empty:
        raise ValueError(f"empty folds: {', '.join(empty)}")

    def fold(k: int) -> FittedFold:
        return fit(known.filter(F.col(f"fold{k}_role") == "train"), features, f"fold_{k}")

    with ThreadPoolExecutor(at_once) as pool:
        fitted = list(pool.map(inheritable_thread_target(df.sparkSession)(fold), range(1, folds + 1)))
    scored = None
    for k, model in enumerate(fitted, 1):
        part = model.score(dealt(known.filter(F.col(f"fold{k}_role") == "test"), counts[f"test{k}"]), keep)
        scored = part if scored is None else scored.unionByName(part)
    return scored, fitted


def coefficient_table(spark: SparkSession, fitted: list[FittedFold]) -> DataFrame:
    """(fold, feature, coefficient, absolute value); the intercept is left out."""
    rows = [
        (f.fold, name, float(v), abs(float(v)))
        for f in fitted
        for name, v in zip(f.features, f.model.coefficients.toArray())
    ]
    return spark.createDataFrame(
        rows, "fold string, feature string, coefficient double, absolute_coefficient double"
    )


def importance_table(spark: SparkSession, fitted: list[FittedFold]) -> DataFrame:
    """(fold, feature, importance): mean decrease of impurity, summing to 1 per fold."""
    rows = [
        (f.fold, name, float(v)) for f in fitted for name, v in zip(f.features, f.model.featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "fold string, feature string, importance double")


def training_diagnostics(spark: SparkSession, fitted: list[FittedFold]) -> DataFrame:
    """(fold, iteration, loss) as the optimiser went along."""
    rows = [(f.fold, i, loss) for f in fitted for i, loss in enumerate(f.history or [])]
    return spark.createDataFrame(rows, "fold string, iteration int, loss double")
