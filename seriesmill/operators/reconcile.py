"""Observed games against official schedules and verified results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.rosters import unordered_pair
from seriesmill.operators.ordering import join_null_safe


def with_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("pair", unordered_pair(F.col(a), F.col(b)))


def reconcile_to_schedule(games: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add series_id and match_status by the unordered pair of teams; never guess.

    The schedule becomes one row per pair first, so one join classifies every game.
    """
    per_pair = (
        with_pair(schedule, "team_a", "team_b")
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__id"))
    )
    out = games.join(per_pair, "pair", "left")
    status = (
        F.when(F.col("pair").isNull(), "NO_TEAM_PAIR")
        .when(F.col("__n").isNull(), "NO_SCHEDULE_MATCH")
        .when(F.col("__n") == 1, "MATCHED")
        .otherwise("AMBIGUOUS")
    )
    return out.withColumns(
        {"match_status": status, "series_id": F.when(F.col("__n") == 1, F.col("__id"))}
    ).drop("__n", "__id")


def schedule_status(schedule: DataFrame, games: DataFrame) -> DataFrame:
    """Per scheduled series: games found against expected, and winners against official.

    ``games`` carry series_id and game_winner. The official winner is joined before the
    games are counted, so counting is one partial aggregate per series.
    """
    official = schedule.select(F.col("id").alias("series_id"), F.col("winner").alias("official_winner"))
    counted = (
        games.filter(F.col("series_id").isNotNull())
        .select("series_id", "game_winner")
        .groupBy("series_id", "game_winner")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(official, "series_id")
        .groupBy("series_id")
        .agg(
            F.sum("n").alias("actual_games"),
            F.sum(F.when(F.col("game_winner") == F.col("official_winner"), F.col("n")).otherwise(0)).alias(
                "winner_seen"
            ),
            F.sum(F.when(F.col("game_winner").isNotNull(), F.col("n")).otherwise(0)).alias("decided"),
        )
    )
    out = schedule.join(counted.withColumnRenamed("series_id", "id"), "id", "left")
    actual = F.coalesce("actual_games", F.lit(0))
    winner = F.coalesce("winner_seen", F.lit(0))
    loser = F.coalesce("decided", F.lit(0)) - winner
    status = (
        F.when(actual == F.col("expected_games"), "COMPLETE").when(actual == 0, "MISSING").otherwise("CHECK")
    )
    winner_status = (
        F.when(actual == 0, "NO_GAMES")
        .when((winner == F.col("winner_games")) & (loser == F.col("loser_games")), "CORRECT")
        .otherwise("CHECK")
    )
    return out.select(
        "id",
        "team_a",
        "team_b",
        "expected_games",
        actual.alias("actual_games"),
        status.alias("status"),
        winner.alias("winner_games_seen"),
        loser.alias("loser_games_seen"),
        winner_status.alias("winner_status"),
    )


def status_totals(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status", "winner_status").agg(F.count(F.lit(1)).alias("series"))


def overlay_verified_results(series: DataFrame, verified: DataFrame) -> DataFrame:
    """Replace the result of verified series after checking that the teams are the same.

    ``verified``: series_id, expected_team_a/b, completed_team_a/b_game_wins,
    completed_series_winner_side, result_source; one row per series. What was observed
    stays. A wrong identity or side stops the job.
    """
    fixes = verified.select(
        "series_id",
        "expected_team_a",
        "expected_team_b",
        "completed_team_a_game_wins",
        "completed_team_b_game_wins",
        "completed_series_winner_side",
        F.col("result_source").alias("__source"),
    )
    out = series.join(fixes, "series_id", "left")
    fixed = F.col("__source").isNotNull()
    side = F.col("completed_series_winner_side")
    same = F.col("expected_team_a").eqNullSafe(F.col("team_a")) & F.col("expected_team_b").eqNullSafe(
        F.col("team_b")
    )
    valid = F.coalesce(same & side.isin("A", "B"), F.lit(False))
    stop = F.raise_error(F.concat(F.lit("verified result does not fit series "), F.col("series_id").cast("string")))
    won = F.when(fixed & ~valid, stop).when(fixed, side).otherwise(F.col("series_winner_side"))
    out = out.withColumn("series_winner_side", won)
    decided = F.col("series_winner_side")
    return out.withColumns(
        {
            "series_winner": F.when(
                fixed, F.when(decided == "A", F.col("team_a")).otherwise(F.col("team_b"))
            ).otherwise(F.col("series_winner")),
            "target_team_a_win": F.when(fixed, (decided == "A").cast("int")).otherwise(
                F.col("target_team_a_win")
            ),
            "result_reconciled": fixed,
            "result_source": F.coalesce("__source", F.lit("observed_replays")),
        }
    ).drop("expected_team_a", "expected_team_b", "__source")


def unknown_verified(series: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified ids that do not name exactly one series: must be empty."""
    found = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = verified.select("series_id").join(found, "series_id", "left")
    return joined.withColumn("rows", F.coalesce("rows", F.lit(0))).filter(F.col("rows") != 1)


def trusted_result_merge(
    df: DataFrame, results: DataFrame, keys: list[str], target: str, columns: list[str]
) -> DataFrame:
    """Left join with trusted results as ``std_*``; see ``merge_problems`` for the gates."""
    right = results.select(*keys, *[F.col(c).alias(f"std_{c}") for c in [target, *columns]])
    return join_null_safe(df, right, keys)


def merge_problems(merged: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """One row: results missing after the merge, and targets that disagree."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"std_{c}").isNull()
    disagree = ~F.col(target).eqNullSafe(F.col(f"std_{target}"))
    return merged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(missing).alias("missing_results"),
        F.count_if(disagree).alias("target_mismatches"),
    )
