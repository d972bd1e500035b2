"""Checks on schemas and data. Name checks cost nothing; data checks are one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that mark a column as known only after the contest.
RESULT_KEYWORDS = ("winner", "target", "completed", "game_wins_observed", "replay_count")

# Predictors that must never be selected.
FORBIDDEN = (
    "target_team_a_win",
    "winner_reaches_required_wins",
    "completed_team_a_game_wins",
    "completed_team_b_game_wins",
    "completed_series_winner_side",
    "team_a_game_wins_observed",
    "team_b_game_wins_observed",
    "series_winner_side",
    "series_winner",
    "replay_count",
    "game_winner",
    "result_reconciled",
    "result_source",
)
FORBIDDEN_KEYWORDS = ("winner", "game_wins_observed", "completed_", "replay_count")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def first_existing(df: DataFrame, candidates: list[str], required: bool = False) -> str | None:
    """The first candidate that is a column: exact spelling first, then any case."""
    for c in candidates:
        if c in df.columns:
            return c
    lower = {c.strip().lower(): c for c in df.columns}
    for c in candidates:
        if c.strip().lower() in lower:
            return lower[c.strip().lower()]
    if required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return None


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_alignment(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """One row per column name: which sources have it, and whether all do."""
    names = sorted({c for df in frames.values() for c in df.columns})
    rows = [
        (n, *[n in df.columns for df in frames.values()], all(n in df.columns for df in frames.values()))
        for n in names
    ]
    flags = ", ".join(f"`{k}` boolean" for k in frames)
    return spark.createDataFrame(rows, f"column_name string, {flags}, shared boolean")


def leakage_columns(names: list[str], keywords: tuple[str, ...] = RESULT_KEYWORDS) -> list[str]:
    """Columns whose name carries a result keyword."""
    return [n for n in names if any(k in n.lower() for k in keywords)]


def forbid_leakage(names: list[str]) -> list[str]:
    """The names again; an error if one of them is a result."""
    bad = [n for n in names if n in FORBIDDEN or any(k in n.lower() for k in FORBIDDEN_KEYWORDS)]
    if bad:
        raise ValueError(f"forbidden predictors: {', '.join(bad)}")
    return names


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table again; an error if a key repeats (the check runs a job)."""
    found = duplicated_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"duplicated keys: {found}")
    return df


def expect(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """(check, found, expected, status) rows from one pass over the data.

    Each check is an aggregate column and the value it must have.
    """
    names = list(checks)
    row = df.agg(*[checks[n][0].cast("long").alias(n) for n in names])
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"),
                F.col(f"`{n}`").alias("found"),
                F.lit(checks[n][1]).cast("long").alias("expected"),
            )
            for n in names
        ]
    )
    status = F.when(F.col("found") == F.col("expected"), "PASS").otherwise("CHECK")
    return row.select(F.explode(entries).alias("e")).select("e.*").withColumn("status", status)


def prediction_problems(preds: DataFrame) -> DataFrame:
    """One row of counts, all zero for valid predictions (id unique per model)."""
    p, y = F.col("probability"), F.col("target")
    # Repeats: rows minus distinct keys, counted after a partial aggregate per key.
    keyed = preds.groupBy("model", "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_target"),
        F.count_if(F.col("prediction").isNull() | ~F.col("prediction").isin(0, 1)).alias("bad_class"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_probability"),
    )
    return keyed.agg(
        F.coalesce(F.sum("bad_target"), F.lit(0)).alias("bad_targets"),
        F.coalesce(F.sum("bad_class"), F.lit(0)).alias("bad_classes"),
        F.coalesce(F.sum("bad_probability"), F.lit(0)).alias("bad_probabilities"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"),
    )


def validate_predictions(preds: DataFrame) -> DataFrame:
    """The predictions again; an error if any is invalid (the check runs a job)."""
    problems = {k: v for k, v in prediction_problems(preds).first().asDict().items() if v}
    if problems:
        raise ValueError(f"invalid predictions: {problems}")
    return preds


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all (one counting job)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reject_reason``: the first rule that holds, else null."""
    reason = reduce(
        lambda chain, item: chain.when(item[1], F.lit(item[0])),
        list(rules.items())[1:],
        F.when(next(iter(rules.values())), F.lit(next(iter(rules)))),
    )
    return df.withColumn("reject_reason", reason)
