"""Joins that put other tables next to games and contests.

None forces a broadcast: Spark compares sizes at run time, and splits hot keys of the
large side, because each join reads straight from its own exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.rules import difference
from seriesmill.sources.tables import written


def attach_metadata(games: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join with only the wanted metadata columns; of repeated keys the greatest row counts."""
    stale = [c for c in columns if c in games.columns]
    one = metadata.groupBy(key).agg(F.max(F.struct(*columns)).alias("__m")).select(key, "__m.*")
    return games.drop(*stale).join(one, key, "left")


def attach_both_sides(contests: DataFrame, stats: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The same statistics for team A and team B of a contest, prefixed by the side."""
    out = contests
    for side in ("a", "b"):
        role = stats.select(
            F.col(key),
            F.col("team").alias(f"team_{side}"),
            *[F.col(c).alias(f"team_{side}_{c}") for c in columns],
        )
        out = out.join(role, [key, f"team_{side}"], "left")
    return out


def overlay_constants(df: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace columns of the rows that ``corrections`` names; null there changes nothing."""
    fixes = corrections.select(key, *[F.col(c).alias(f"__fix_{c}") for c in columns])
    out = df.join(fixes, key, "left")
    return out.withColumns({c: F.coalesce(f"__fix_{c}", c) for c in columns}).drop(
        *[f"__fix_{c}" for c in columns]
    )


def remove_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the list."""
    return df.join(listed.select(key), key, "left_anti")


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the list."""
    return df.join(listed.select(key), key, "left_semi")


def roster_history(
    rosters: DataFrame, history: DataFrame, stats: list[str], key: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Per distinct roster text: players, matched, with statistics, coverage, means.

    Statistics of a roster are worked out once, not once per contest that shows it. Players are
    matched by name, or by ``key`` of it, by which the history must have one row each.
    """
    key = key or (lambda name: name)
    players = (
        rosters.select("roster")
        .distinct()
        .select(
            "roster",
            F.explode_outer(F.filter(F.split("roster", "\\|"), lambda p: F.trim(p) != "")).alias("player"),
        )
        .withColumn("player", F.trim("player"))
    )
    known = history.withColumn("__key", key(F.col("player"))).drop("player").withColumn("__known", F.lit(True))
    matched = players.withColumn("__key", key(F.col("player"))).join(known, "__key", "left")
    any_stat = F.coalesce(*[F.col(f"`{s}`") for s in stats]).isNotNull()
    total = F.count("player")
    with_stats = F.count_if(F.col("__known") & any_stat)
    return matched.groupBy("roster").agg(
        total.alias("players_total"),
        F.count("__known").alias("players_matched"),
        with_stats.alias("players_with_stats"),
        F.when(total > 0, with_stats / total).alias("coverage"),
        *[F.avg(f"`{s}`").alias(f"{s}_mean") for s in stats],
    )


def roster_history_features(
    series: DataFrame, history: DataFrame, stats: list[str], key: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Roster statistics of both sides and their A - B differences.

    The table of rosters is written: both sides read it, and the series are not dealt out by
    roster where it is small.
    """
    sides = F.explode(F.array("team_a_players", "team_b_players"))
    per_roster = written(roster_history(series.select(sides.alias("roster")), history, stats, key), "rosters")
    columns = [c for c in per_roster.columns if c != "roster"]
    out = series
    for side in ("a", "b"):
        role = per_roster.select(
            F.col("roster").alias(f"team_{side}_players"),
            *[F.col(f"`{c}`").alias(f"team_{side}_{c}") for c in columns],
        )
        out = out.join(role, f"team_{side}_players", "left")
    return out.withColumns(
        {f"diff_{s}": difference(F.col(f"team_a_{s}_mean"), F.col(f"team_b_{s}_mean")) for s in stats}
    )


def unmatched_players(series: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct players of any roster that the history does not know."""
    names = F.explode(F.split(F.concat_ws("|", "team_a_players", "team_b_players"), "\\|"))
    return (
        series.select(names.alias("player"))
        .withColumn("player", F.trim("player"))
        .filter(F.col("player") != "")
        .distinct()
        .join(history.select("player"), "player", "left_anti")
    )
