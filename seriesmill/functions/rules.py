"""Contest rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def winner_from_goals(a: Column, b: Column, if_a: Column, if_b: Column) -> Column:
    """The side with more goals; a tie or a missing value has no winner."""
    return F.when(a > b, if_a).when(b > a, if_b)


def winner_from_score(a: Column, b: Column, if_a: Column, if_b: Column) -> Column:
    """Winner by performance score, '' on a tie: the uncorrected label kept for audits."""
    return F.when(a > b, if_a).when(b > a, if_b).otherwise(F.lit(""))


def winner_else_b(a: Column, b: Column, if_a: Column, if_b: Column) -> Column:
    """A only with strictly more; every other case, ties included, goes to B."""
    return F.when(a > b, if_a).otherwise(if_b)


def wins_required(stage: Column) -> Column:
    """3 wins decide a group-stage series, 4 any other."""
    return F.when(F.lower(F.coalesce(stage, F.lit(""))).contains("group"), F.lit(3)).otherwise(F.lit(4))


def is_playoff(stage: Column) -> Column:
    return F.coalesce(F.lower(stage).contains("playoff"), F.lit(False)).cast("int")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Elapsed minutes with microsecond resolution."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def series_key(ts: Column, fingerprint: Column, missing: str = "UNKNOWN_MATCHUP") -> Column:
    """Date and matchup; a placeholder stands for an unknown matchup."""
    return F.concat_ws(" | ", F.to_date(ts).cast("string"), F.coalesce(fingerprint, F.lit(missing)))


def format_series_id(prefix: Column, number: Column, width: int = 3) -> Column:
    """``O1_007``; numbers wider than ``width`` are kept whole."""
    digits = number.cast("string")
    return F.concat(prefix, F.lit("_"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def decide(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def difference(a: Column, b: Column) -> Column:
    """A - B as a double, null when either side is null."""
    return a.cast("double") - b.cast("double")


def expanding_role(period: Column, fold: int) -> Column:
    """Fold k trains on periods up to k and tests on period k + 1."""
    return F.when(period <= fold, "train").when(period == fold + 1, "test").otherwise("unused")
