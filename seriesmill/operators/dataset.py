"""From contests with features to the modelling table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.rules import expanding_role, is_playoff
from seriesmill.functions.text import to_double_lenient
from seriesmill.operators.checks import forbid_leakage

# Families of predictors in their order.
COVERAGE_FEATURES = [
    "team_a_players_with_stats",
    "team_b_players_with_stats",
    "team_a_coverage",
    "team_b_coverage",
]
FORM_DIFF_FEATURES = [
    "diff_prior_series_played",
    "diff_prior_series_win_rate",
    "diff_prior_game_win_rate",
    "diff_prior_series_win_streak",
    "diff_recent3_series_win_rate",
    "diff_recent5_series_win_rate",
    "diff_recent3_avg_game_win_rate",
    "diff_recent5_avg_game_win_rate",
]
FORM_COVERAGE_FEATURES = [
    "team_a_prior_series_played",
    "team_b_prior_series_played",
    "team_a_recent3_series_played",
    "team_b_recent3_series_played",
    "team_a_recent5_series_played",
    "team_b_recent5_series_played",
]
STAGE_FEATURES = ["is_playoff"]
MISSING_SUFFIX = "__missing"


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def feature_families(columns: list[str]) -> dict[str, list[str]]:
    """Predictors present among ``columns``, by family, in their fixed order."""
    have = {c for c in columns if not c.endswith(MISSING_SUFFIX)}
    history = sorted(c for c in have if c.startswith(("diff_career_", "diff_2024_")))
    return {
        "history_difference": history,
        "history_coverage": [c for c in COVERAGE_FEATURES if c in have],
        "form_difference": [c for c in FORM_DIFF_FEATURES if c in have],
        "form_coverage": [c for c in FORM_COVERAGE_FEATURES if c in have],
        "prematch_stage": [c for c in STAGE_FEATURES if c in have],
    }


def feature_columns(columns: list[str]) -> list[str]:
    """All predictors once, in family order; an error if one is a result."""
    flat = [c for family in feature_families(columns).values() for c in family]
    return forbid_leakage(list(dict.fromkeys(flat)))


def select_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, then every predictor as a double; stage becomes is_playoff."""
    if "stage" in df.columns:
        df = df.withColumn("is_playoff", is_playoff(F.col("stage")))
    names, types = feature_columns(df.columns), dict(df.dtypes)
    return df.select(*keep, *[_as_double(F.col(f"`{c}`"), types[c]).alias(c) for c in names])


def _as_double(c: Column, dtype: str) -> Column:
    """What ``to_double_lenient`` gives; a column that is a number already does not go through its text."""
    if dtype not in ("double", "bigint", "int", "smallint", "tinyint"):
        return to_double_lenient(c)
    value = c.cast("double")
    return F.when(~F.isnan(value), value) if dtype == "double" else value


def feature_report(spark: SparkSession, names: list[str]) -> DataFrame:
    """(feature, feature_group) for the final inputs, indicators included."""
    families = feature_families(names)
    group_of = {c: g for g, cs in families.items() for c in cs}

    def group(c: str) -> str:
        return group_of.get(c) or ("missingness_indicator" if c.endswith(MISSING_SUFFIX) else "other")

    return spark.createDataFrame([(c, group(c)) for c in names], "feature string, feature_group string")


def feature_group_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("feature_group").agg(F.count(F.lit(1)).alias("features"))


def coalesce_columns(df: DataFrame, name: str, candidates: list[str]) -> DataFrame:
    """First non-null of the candidate columns the frame has, as a double."""
    present = [to_double_lenient(F.col(c)) for c in candidates if c in df.columns]
    return df.withColumn(name, F.coalesce(*present) if present else F.lit(None).cast("double"))


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>__missing`` for each column that holds a null (one counting job)."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    holes = [c for c in columns if counts[c]]
    return df.withColumns({f"{c}{MISSING_SUFFIX}": F.col(f"`{c}`").isNull().cast("int") for c in holes})


def assign_expanding_folds(df: DataFrame, period: str, folds: int) -> DataFrame:
    """``fold<k>_role``: train on periods up to k, test on k + 1, else unused."""
    return df.withColumns({f"fold{k}_role": expanding_role(F.col(period), k) for k in range(1, folds + 1)})


def all_missing(columns: list[str]) -> Column:
    """True where every one of the columns is null."""
    return F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNull()
