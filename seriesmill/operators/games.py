"""Per-game rows: rosters of both colours, side statistics, orientation, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.rosters import matchup_fingerprint
from seriesmill.functions.rules import winner_from_goals
from seriesmill.operators.ordering import join_null_safe

COLOURS = ("blue", "orange")

# The statistics of one side, and how players add up to a side.
SUMMED = (
    "goals",
    "assists",
    "saves",
    "shots",
    "amount_collected",
    "amount_stolen",
    "total_distance",
    "time_ball_possession",
    "time_in_front_ball",
    "time_behind_ball",
    "time_offensive_half",
    "time_defensive_half",
    "demos_inflicted",
    "demos_taken",
)
AVERAGED = ("shooting_percentage", "bpm", "avg_boost")


def player_matchups(players: DataFrame, game: str = "game_id", distinct: bool = True) -> DataFrame:
    """Rosters, player counts and fingerprint per game; blank names are left out.

    Names are made unique per game before they are gathered, so a gathered list is as
    long as a roster, however many rows name the same player. With ``distinct=False``
    a player listed twice stays twice and order ignores case.
    """
    named = players.filter(F.trim("player") != "").select(
        game, F.lower(F.trim("color")).alias("color"), F.trim("player").alias("player")
    )
    counted = named.groupBy(game, "color", "player").agg(F.count(F.lit(1)).alias("times"))
    # (lower case, name, times) sorts ignoring case; (name, name, times) by code point.
    key = F.col("player") if distinct else F.lower("player")
    entry = F.struct(key.alias("k"), F.col("player").alias("name"), F.col("times"))
    gathered = [
        F.array_sort(F.collect_list(F.when(F.col("color") == c, entry))).alias(f"{c}_players")
        for c in COLOURS
    ]

    def names(c: str):
        if distinct:
            return F.transform(f"{c}_players", lambda e: e["name"])
        return F.flatten(
            F.transform(f"{c}_players", lambda e: F.array_repeat(e["name"], e["times"].cast("int")))
        )

    out = counted.groupBy(game).agg(*gathered)
    out = out.select(game, *[names(c).alias(f"{c}_players") for c in COLOURS])
    signature = {c: F.concat_ws("|", f"{c}_players") for c in COLOURS}
    return out.withColumns(
        {f"{c}_player_count": F.size(f"{c}_players").cast("long") for c in COLOURS}
        | {"fingerprint": matchup_fingerprint(signature["blue"], signature["orange"])}
    )


def side_cells(colour: Column, source: str = "players") -> list[Column]:
    """blue_*/orange_* aggregates of the statistics columns."""
    cells = []
    for c in COLOURS:
        for s in SUMMED + AVERAGED:
            how = F.max if source == "team" else (F.sum if s in SUMMED else F.avg)
            cells.append(how(F.when(colour == c, F.col(s))).alias(f"{c}_{s}"))
    return cells


def aggregate_sides(stats: DataFrame, game: str = "game_id", source: str = "players") -> DataFrame:
    """blue_*/orange_* statistics per game, null where every value is null.

    ``source='players'`` sums counts and averages rates over a side's players;
    ``source='team'`` copies the one row a team export has per colour.
    """
    return stats.groupBy(game).agg(*side_cells(F.lower(F.trim("color")), source))


def team_means(players: DataFrame, stats: list[str], keys: list[str]) -> DataFrame:
    """Mean of each player statistic per game and team."""
    return players.groupBy(*keys).agg(*[F.avg(s).alias(f"avg_{s}") for s in stats])


def colour_to_team(players: DataFrame, teams: DataFrame, game: str = "game_id") -> DataFrame:
    """Give player rows the team name of their colour; of duplicates the last row wins."""
    names = teams.groupBy(game, "color").agg(F.max_by("team", "row_no").alias("team"))
    return players.join(names, [game, "color"], "left")


def orient_lexicographic(games: DataFrame) -> DataFrame:
    """Side A is the roster that sorts first, whichever colour it played.

    Needs fingerprint, blue/orange_players as text, team and goals. A game whose two
    rosters are not those of the fingerprint keeps null sides and raises the flag.
    """
    sides = F.split("fingerprint", " \\|\\| ")
    out = games.withColumns(
        {"team_a_players": F.get(sides, F.lit(0)), "team_b_players": F.get(sides, F.lit(1))}
    )
    return _oriented(out)


def _oriented(games: DataFrame) -> DataFrame:
    """Turn blue/orange into A/B by roster equality with team_a/b_players."""
    blue, orange = F.col("blue_players"), F.col("orange_players")
    a, b = F.col("team_a_players"), F.col("team_b_players")
    straight = (blue == a) & (orange == b)
    swapped = (blue == b) & (orange == a)

    def pick(if_straight: str, if_swapped: str):
        return F.when(straight, F.col(if_straight)).when(swapped, F.col(if_swapped))

    out = games.withColumns(
        {
            "orientation_error": F.coalesce(~(straight | swapped), F.lit(True)),
            "team_a_colour": F.when(straight, "blue").when(swapped, "orange").otherwise("unresolved"),
            "team_a": pick("blue_team", "orange_team"),
            "team_b": pick("orange_team", "blue_team"),
            "a_goals": pick("blue_goals", "orange_goals"),
            "b_goals": pick("orange_goals", "blue_goals"),
        }
    )
    winner = winner_from_goals(F.col("a_goals"), F.col("b_goals"), F.lit("A"), F.lit("B"))
    return out.withColumn("winner_side", winner)


def orient_by_first_game(games: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Side A is the blue side of the first game of each key.

    The anchor is one row per key found by a partial aggregate, not a window.
    """
    first = F.min_by(F.struct("blue_players", "orange_players"), F.struct(*order))
    anchors = games.groupBy(*keys).agg(first.alias("anchor"))
    anchors = anchors.select(
        *keys,
        F.col("anchor.blue_players").alias("team_a_players"),
        F.col("anchor.orange_players").alias("team_b_players"),
    )
    return _oriented(join_null_safe(games, anchors, keys))


def audit_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row: how many values changed, null compared as a value."""
    changed = ~F.col(old).eqNullSafe(F.col(new))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(changed).alias("changed"),
        F.count_if(changed & F.col(new).isNull()).alias("changed_to_null"),
    )


def changed_rows(df: DataFrame, old: str, new: str) -> DataFrame:
    """The rows whose value was corrected."""
    return df.filter(~F.col(old).eqNullSafe(F.col(new)))
