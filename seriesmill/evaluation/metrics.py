"""Scores of predictions (id, fold, target, model, probability, prediction).

Every metric is a partial aggregate per key; where order matters (AUC, ROC points,
calibration edges) equal scores are merged first and the rest is scanned in runs of
scores with bounds from a sample, so a model or fold holding most rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesmill.functions.rules import decide
from seriesmill.functions.text import to_double_lenient
from seriesmill.operators.checks import first_existing
from seriesmill.operators.ordering import cut, exact_quantiles, exclusive_totals, join_null_safe
from seriesmill.sources.tables import written

# Probability clip of the log loss (spacing of doubles at 1).
EPSILON = 2.220446049250313e-16
HIGHER_IS_BETTER = {"accuracy": True, "f1": True, "roc_auc": True, "log_loss": False, "brier_score": False}
METRICS = list(HIGHER_IS_BETTER)

# Column synonyms of prediction tables, first match wins.
PREDICTION_COLUMNS = {
    "id": ["series_id", "series", "match_id"],
    "target": ["target_team_a_win", "target", "y_true", "actual"],
    "probability": [
        "predicted_probability",
        "predicted_probability_team_a_win",
        "probability_team_a_win",
        "team_a_win_probability",
        "predicted_proba",
        "y_probability",
        "y_prob",
        "probability",
    ],
    "prediction": ["predicted_class", "prediction", "y_pred", "predicted"],
    "fold": ["fold", "test_fold", "evaluation_fold"],
}
TOURNAMENT_COLUMNS = ["tournament", "open", "event"]


def standardise_predictions(df: DataFrame, model: str) -> DataFrame:
    """Resolve column synonyms and types; values that are no numbers become null."""
    found = {k: first_existing(df, names, required=True) for k, names in PREDICTION_COLUMNS.items()}
    tournament = next((c for c in TOURNAMENT_COLUMNS if c in df.columns), None)
    return df.select(
        F.trim(F.col(found["id"]).cast("string")).alias("id"),
        F.lit(model).alias("model"),
        (F.trim(F.col(tournament).cast("string")) if tournament else F.lit("")).alias("tournament"),
        F.trim(F.col(found["fold"]).cast("string")).alias("fold"),
        to_double_lenient(F.col(found["target"])).cast("int").alias("target"),
        to_double_lenient(F.col(found["probability"])).alias("probability"),
        to_double_lenient(F.col(found["prediction"])).cast("int").alias("prediction"),
    )


def with_decisions(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the class at the threshold and whether it is right."""
    out = preds.withColumn("prediction", decide(F.col("probability"), threshold))
    return out.withColumn("correct", (F.col("prediction") == F.col("target")).cast("int"))


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1).cast("long")


def confusion(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp per key."""
    y, c, w = F.col("target"), F.col("prediction"), _weight(weight)

    def cell(target: int, prediction: int) -> Column:
        return F.sum(F.when((y == target) & (c == prediction), w).otherwise(0))

    return preds.groupBy(*keys).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(table: DataFrame) -> DataFrame:
    """Rates that follow from tn, fp, fn, tp; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return table.withColumns(
        {
            "n": n,
            "positive_rate": _ratio(tp + fn, n),
            "predicted_positive_rate": _ratio(tp + fp, n),
            "accuracy": _ratio(tn + tp, n),
            "precision": precision,
            "recall": recall,
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def _log_loss_of(p: Column, positive: bool) -> Column:
    """Loss of one prediction whose target is known, with the score kept off 0 and 1."""
    kept = F.greatest(F.least(p, F.lit(1.0 - EPSILON)), F.lit(EPSILON))
    return -F.log(kept if positive else 1 - kept)


def log_loss_term() -> Column:
    p = F.col("probability")
    return F.when(F.col("target") == 1, _log_loss_of(p, True)).otherwise(_log_loss_of(p, False))


def brier_term() -> Column:
    miss = F.col("probability") - F.col("target")
    return miss * miss


def probability_losses(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Log loss and Brier score per key."""
    w = _weight(weight)
    return preds.groupBy(*keys).agg(
        (F.sum(w * log_loss_term()) / F.sum(w)).alias("log_loss"),
        (F.sum(w * brier_term()) / F.sum(w)).alias("brier_score"),
    )


def _by_score(preds: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    w = _weight(weight)
    return preds.groupBy(*keys, "probability").agg(
        F.sum(F.when(F.col("target") == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("target") == 0, w).otherwise(0)).alias("neg"),
    )


def roc_auc(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """AUC per key: won pairs plus half the tied ones; null with one class only."""
    return _area(written(_by_score(preds, keys, weight), "scores"), keys)


def _area(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``u`` counts won and half the tied pairs inside a run of scores; runs merge
    like sums, plus every positive above times every negative below."""
    made = cut(scores, keys, ["probability"])
    pos = F.col("pos").cast("double")

    def with_lower(df: DataFrame, order: WindowSpec) -> DataFrame:
        lower = F.sum("neg").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("u", F.col("u") + pos * F.coalesce(lower, F.lit(0)))

    def summed(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "u")])

    pairs = summed(with_lower(made.df.withColumn("u", pos * F.col("neg") / F.lit(2.0)), made.window()), made.parts)
    if made.large:
        pairs = summed(with_lower(pairs, made.pieces()), keys)
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    area = F.when(both, F.col("u") / (pos * F.col("neg")))
    return pairs.select(*keys, area.alias("roc_auc"))


def metric_table(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """All metrics per key in one row.

    Every metric depends on (score, class, target) only, so equal ones are merged first
    and the predictions are read and shuffled once.
    """
    return _metrics_of(written(_merged(preds, keys, weight), "scores"), keys)


CELLS = ("tn", "fp", "fn", "tp")


def _merged(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Weights by key, score and confusion cell."""
    w, y = _weight(weight), F.col("target")
    yes = F.col("prediction") == 1

    def cell(target: int, decided: Column) -> Column:
        return F.sum(F.when((y == target) & decided, w).otherwise(0))

    return preds.groupBy(*keys, "probability").agg(
        cell(0, ~yes).alias("tn"), cell(0, yes).alias("fp"), cell(1, ~yes).alias("fn"), cell(1, yes).alias("tp")
    )


def _metrics_of(merged: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("probability")
    pos, neg = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")
    losses = pos * _log_loss_of(p, True) + neg * _log_loss_of(p, False)
    misses = pos * (p - 1) * (p - 1) + neg * p * p
    n = F.sum(pos + neg)
    sums = merged.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in CELLS],
        (F.sum(losses) / n).alias("log_loss"),
        (F.sum(misses) / n).alias("brier_score"),
    )
    area = _area(merged.select(*keys, "probability", pos.alias("pos"), neg.alias("neg")), keys)
    return join_null_safe(with_rates(sums), area, keys)


def metrics_by_scope(preds: DataFrame) -> DataFrame:
    """Pooled rows and one row per fold, for each model; the pooled ones add up the folds' merged scores."""
    by_fold = written(_merged(preds, ["model", "fold"]), "scores")
    pooled = written(by_fold.groupBy("model", "probability").agg(*[F.sum(c).alias(c) for c in CELLS]), "scores")
    pooled = _metrics_of(pooled, ["model"]).withColumn("fold", F.lit("pooled"))
    return pooled.unionByName(_metrics_of(by_fold, ["model", "fold"]))


def roc_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first, from (0, 0) on."""
    scores = written(_by_score(preds, keys, None), "scores")
    made = cut(scores, keys, [-F.col("probability")])
    totals = scores.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    down_to = made.window().rowsBetween(Window.unboundedPreceding, 0)
    local = made.df.withColumns({f"in_{c}": F.sum(c).over(down_to) for c in ("pos", "neg")})
    if made.large:
        sums = made.df.groupBy(*made.parts).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        local = join_null_safe(local, exclusive_totals(sums, made, ["pos", "neg"]).drop("pos", "neg"), made.parts)
    else:
        local = local.withColumns({f"before_{c}": F.lit(0) for c in ("pos", "neg")})
    joined = join_null_safe(local, totals, keys)
    points = joined.select(
        *keys,
        F.col("probability").alias("threshold"),
        F.try_divide(F.col("in_neg") + F.col("before_neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("in_pos") + F.col("before_pos"), F.col("all_pos")).alias("tpr"),
    )
    start = totals.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def calibration(preds: DataFrame, keys: list[str], n_bins: int = 5) -> DataFrame:
    """Mean score and observed rate per quantile bin; bins with rows are numbered from 1."""
    inner = [k / n_bins for k in range(1, n_bins)]
    preds = written(preds.select(*keys, "probability", "target"), "scores")
    edges = (
        exact_quantiles(preds, keys, "probability", inner, "edge")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    )
    binned = join_null_safe(preds, edges, keys).withColumn(
        "slot", F.size(F.filter("edges", lambda e: e < F.col("probability")))
    )
    bins = binned.groupBy(*keys, "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("probability").alias("mean_predicted_probability"),
        F.avg("target").alias("observed_rate"),
    )
    # At most n_bins rows a key.
    number = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("slot"))
    return bins.withColumn("bin", number).drop("slot")


def compare_models_wide(preds: DataFrame, models: list[str]) -> DataFrame:
    """One row per contest: score, class and correctness of each listed model."""
    cells = []
    for m in models:
        mine = F.col("model") == m
        for c in ("probability", "prediction", "correct"):
            cells.append(F.max(F.when(mine, F.col(c))).alias(f"{m}_{c}"))
    out = preds.groupBy("id", "fold", "target").agg(*cells)
    right = sum((F.coalesce(f"{m}_correct", F.lit(0)) for m in models), F.lit(0))
    return out.withColumns({"models_correct": right, "models_wrong": F.lit(len(models)) - right})


def error_overlap(wide: DataFrame) -> DataFrame:
    """How many contests 0, 1, ... models get wrong, and in percent."""
    counts = wide.groupBy("models_wrong").agg(F.count(F.lit(1)).alias("contests"))
    total = F.sum("contests").over(Window.partitionBy(F.lit(0)))  # one row per model count
    return counts.withColumn("percentage", F.lit(100.0) * F.col("contests") / total)


def missed_by_all(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.filter(F.col("models_wrong") == len(models))


def rank_models(table: DataFrame, metric: str) -> DataFrame:
    """Models from best to worst by one metric."""
    best_first = F.desc(metric) if HIGHER_IS_BETTER[metric] else F.asc(metric)
    order = Window.partitionBy(F.lit(0)).orderBy(best_first)  # one row per model
    return table.select("model", metric, F.rank().over(order).alias("rank"))


def rank_by_all(table: DataFrame) -> DataFrame:
    """(model, metric, rank) for every metric, from one pass over the table of one row per model."""
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) * (-1 if up else 1)).alias("worse"))
        for m, up in HIGHER_IS_BETTER.items()
    ]
    long = table.select("model", F.explode(F.array(*cells)).alias("c")).select("model", "c.*")
    rank = F.rank().over(Window.partitionBy("metric").orderBy(F.asc_nulls_last("worse")))
    return long.select("model", "metric", rank.alias("rank"))


def alignment_problems(preds: DataFrame, models: list[str]) -> DataFrame:
    """Contests some model lacks or scores with another target or fold: must be empty."""
    per_id = preds.filter(F.col("model").isin(*models)).groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("model") == m).alias(f"n_{i}") for i, m in enumerate(models)],
        (F.min("target").eqNullSafe(F.max("target")) & F.min("fold").eqNullSafe(F.max("fold"))).alias("same"),
    )
    each_once = F.lit(True)
    for i in range(len(models)):
        each_once = each_once & (F.col(f"n_{i}") == 1)
    return per_id.filter(~each_once | ~F.col("same")).select("id", "rows", "same")


def check_aligned(preds: DataFrame, models: list[str]) -> DataFrame:
    """The predictions again; an error if the models do not score the same contests."""
    bad = alignment_problems(preds, models).limit(5).collect()
    if bad:
        raise ValueError(f"predictions are not aligned: {bad}")
    return preds


def majority_baseline(df: DataFrame, role: str) -> DataFrame:
    """Class with the larger train share (0.5 counts as 1) and its accuracy on test."""
    y = F.col("target")
    sums = df.agg(
        F.avg(F.when(F.col(role) == "train", y)).alias("train_positive_rate"),
        F.count(F.when(F.col(role) == "test", y)).alias("test_rows"),
        F.avg(F.when(F.col(role) == "test", y)).alias("__rate"),
    )
    majority = (F.col("train_positive_rate") >= 0.5).cast("int")
    return sums.select(
        F.lit(role).alias("role"),
        "train_positive_rate",
        majority.alias("majority_class"),
        "test_rows",
        F.when(majority == 1, F.col("__rate")).otherwise(1 - F.col("__rate")).alias("test_accuracy"),
    )
