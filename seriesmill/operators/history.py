"""Form of a team strictly before each moment, and the leakage audits on top of it.

Contests need: contest_id, ts, tournament_order, team_a, team_b, target (1, 0 or null
while undecided) and a_games, b_games. Contests at one timestamp never see each other;
an undecided contest receives features and adds nothing to anybody's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.rules import difference
from seriesmill.operators.ordering import PIECE, Cut, cut
from seriesmill.sources.tables import written

WINDOWS = (3, 5)
#: Order of a team's contests.
PLACE = ["ts", "tournament_order", "contest_id", "side"]
TOTALS = ("wins", "losses", "game_wins", "game_losses")


def participants(contests: DataFrame) -> DataFrame:
    """One row per team and contest, seen from that team's side."""
    sides = F.array(
        F.struct(
            F.lit("A").alias("side"),
            F.coalesce("team_a", F.lit("")).alias("team"),
            F.col("target").cast("int").alias("won"),
            F.col("a_games").alias("game_wins"),
            F.col("b_games").alias("game_losses"),
        ),
        F.struct(
            F.lit("B").alias("side"),
            F.coalesce("team_b", F.lit("")).alias("team"),
            (1 - F.col("target")).cast("int").alias("won"),
            F.col("b_games").alias("game_wins"),
            F.col("a_games").alias("game_losses"),
        ),
    )
    return contests.select(
        "contest_id", "ts", "tournament_order", F.explode(sides).alias("s")
    ).select("contest_id", "ts", "tournament_order", "s.*")


def _newest_up_to_here(df: DataFrame, parts: list[str], order: list[str], k: int) -> DataFrame:
    """``newest`` of rows that have it becomes the last k entries up to and including theirs.

    Rows without a decided contest (null) are set apart, so k rows always reach back
    k results; such rows stay null.
    """
    back = Window.partitionBy(*parts, F.col("newest").isNull()).orderBy(*order).rowsBetween(1 - k, 0)
    reached = F.slice(F.flatten(F.reverse(F.collect_list("newest").over(back))), 1, k)
    return df.withColumn("newest", F.when(F.col("newest").isNotNull(), reached))


def _state_before(made: Cut, k: int) -> DataFrame:
    """Per row the totals, the newest k results and the last loss of all rows of the team before it.

    ``mark`` is the number of wins a team had at its last loss: wins so far minus the
    mark is the current streak. In a team that is cut, pieces carry their state to the next.
    """
    before = made.window().rowsBetween(Window.unboundedPreceding, -1)
    decided = F.col("won").isNotNull()
    games = F.col("game_wins") + F.col("game_losses")
    result = F.struct(F.col("won").alias("won"), F.when(games > 0, F.col("game_wins") / games).alias("rate"))
    counts = {
        "wins": F.col("won"),
        "losses": 1 - F.col("won"),
        "game_wins": F.when(decided, F.col("game_wins")),
        "game_losses": F.when(decided, F.col("game_losses")),
    }
    rows = made.df.withColumns({**{f"own_{t}": F.coalesce(c, F.lit(0)) for t, c in counts.items()}, "newest": F.when(decided, F.array(result))})
    rows = _newest_up_to_here(rows, made.parts, PLACE, k)
    local = (
        rows.withColumns({f"in_{t}": F.coalesce(F.sum(f"own_{t}").over(before), F.lit(0)) for t in TOTALS})
        .withColumn("in_newest", F.last("newest", ignorenulls=True).over(before))
        .withColumn("mark", F.when(F.col("won") == 0, F.col("in_wins")))
        .withColumn("in_mark", F.max("mark").over(before))
        .withColumn("in_ts", F.lag("ts").over(made.window()))
    )
    if not made.large:
        nothing = {f"up_{t}": F.lit(0).cast("long") for t in TOTALS}
        return local.withColumns({**nothing, "up_mark": F.lit(0).cast("long"), "up_newest": F.lit(None).cast(local.schema["newest"].dataType), "up_ts": F.lit(None).cast("timestamp")})
    place = F.struct(*PLACE)
    pieces = local.groupBy(*made.parts).agg(
        *[F.sum(f"own_{t}").alias(t) for t in TOTALS],
        F.max("mark").alias("mark"),
        F.max_by("newest", F.when(F.col("newest").isNotNull(), place)).alias("newest"),
        F.max("ts").alias("last_ts"),
    )
    earlier = made.pieces().rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        _newest_up_to_here(pieces, ["team"], [PIECE], k)
        .withColumns({f"up_{t}": F.coalesce(F.sum(t).over(earlier), F.lit(0)) for t in TOTALS})
        .withColumn("up_mark", F.coalesce(F.max(F.col("mark") + F.col("up_wins")).over(earlier), F.lit(0)))
        .withColumn("up_newest", F.last("newest", ignorenulls=True).over(earlier))
        .withColumn("up_ts", F.last("last_ts").over(earlier))
        .select(*made.parts, *[f"up_{t}" for t in TOTALS], "up_mark", "up_newest", "up_ts")
    )
    return local.join(carried, made.parts)


def team_history(contests: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Form per (team, ts), from contests strictly before ts.

    A team's contests are one run in order; what holds before the first contest of a moment
    is what that moment sees. Teams with very many contests are cut along that order.
    """
    k = max(windows)
    state = _state_before(cut(participants(contests), ["team"], PLACE), k)
    first = F.coalesce("in_ts", "up_ts").isNull() | (F.coalesce("in_ts", "up_ts") < F.col("ts"))
    joined = state.filter(first)
    total = {t: F.col(f"up_{t}") + F.col(f"in_{t}") for t in TOTALS}
    last_mark = F.greatest("up_mark", F.coalesce(F.col("up_wins") + F.col("in_mark"), F.lit(0)))
    played = total["wins"] + total["losses"]
    games = total["game_wins"] + total["game_losses"]
    history = joined.select(
        "team",
        "ts",
        played.alias("prior_series_played"),
        total["wins"].alias("prior_series_wins"),
        total["losses"].alias("prior_series_losses"),
        F.when(played > 0, total["wins"] / played).alias("prior_series_win_rate"),
        total["game_wins"].alias("prior_game_wins"),
        total["game_losses"].alias("prior_game_losses"),
        F.when(games > 0, total["game_wins"] / games).alias("prior_game_win_rate"),
        (total["wins"] - last_mark).alias("prior_series_win_streak"),
        F.slice(
            F.concat(F.coalesce("in_newest", F.array()), F.coalesce("up_newest", F.array())), 1, k
        ).alias("newest"),
    )
    for w in windows:
        recent = F.slice("newest", 1, w)
        n = F.size(recent).cast("long")
        won = F.aggregate(recent, F.lit(0.0), lambda acc, r: acc + r["won"])
        # One series without games has no rate and makes the whole mean null.
        rates = F.aggregate(recent, F.lit(0.0), lambda acc, r: acc + r["rate"])
        history = history.withColumns(
            {
                f"recent{w}_series_played": n,
                f"recent{w}_series_win_rate": F.when(n > 0, won / n),
                f"recent{w}_avg_game_win_rate": F.when(n > 0, rates / n),
            }
        )
    return history.drop("newest")


def form_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    names = [
        "prior_series_played",
        "prior_series_wins",
        "prior_series_losses",
        "prior_series_win_rate",
        "prior_game_wins",
        "prior_game_losses",
        "prior_game_win_rate",
        "prior_series_win_streak",
    ]
    for w in windows:
        names += [f"recent{w}_series_played", f"recent{w}_series_win_rate", f"recent{w}_avg_game_win_rate"]
    return names


def diff_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    """Form columns of which the A - B difference is a feature."""
    names = [
        "prior_series_played",
        "prior_series_win_rate",
        "prior_game_win_rate",
        "prior_series_win_streak",
    ]
    for w in windows:
        names += [f"recent{w}_series_win_rate", f"recent{w}_avg_game_win_rate"]
    return names


def attach_history(contests: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """Put a team's history next to both sides of each contest; written, as both sides read it."""
    history, out = written(history, "history"), contests
    for side in ("a", "b"):
        role = history.select(
            F.col("team").alias("__team"),
            F.col("ts").alias("__ts"),
            *[F.col(c).alias(f"team_{side}_{c}") for c in columns],
        )
        out = out.join(
            role,
            (F.coalesce(F.col(f"team_{side}"), F.lit("")) == F.col("__team")) & (F.col("ts") == F.col("__ts")),
            "left",
        ).drop("__team", "__ts")
    return out


def diff_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """``diff_x`` = A - B for each form column."""
    return df.withColumns(
        {f"diff_{c}": difference(F.col(f"team_a_{c}"), F.col(f"team_b_{c}")) for c in columns}
    )


def form_features(contests: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Contests with both sides' form and the A - B differences.

    Here and below the contests are written once: counting, history and both sides read them.
    """
    contests = written(contests, "contests")
    history = team_history(contests, windows)
    return diff_features(attach_history(contests, history, form_columns(windows)), diff_columns(windows))


def prior_history(contests: DataFrame) -> DataFrame:
    """Counts and rates before each contest, without the recent windows."""
    contests = written(contests, "contests")
    history = team_history(contests, (1,))
    return attach_history(contests, history, form_columns(())[:-1])


def recent_k(contests: DataFrame, k: int) -> DataFrame:
    """The last k decided series before each contest."""
    contests = written(contests, "contests")
    history = team_history(contests, (k,))
    return attach_history(contests, history, form_columns((k,))[-3:])


def win_streak(contests: DataFrame) -> DataFrame:
    """Wins since the last loss before each contest."""
    contests = written(contests, "contests")
    return attach_history(contests, team_history(contests, (1,)), ["prior_series_win_streak"])


def sides_of(features: DataFrame, column: str = "prior_series_played") -> DataFrame:
    """Rows (team, ts, tournament_order, contest_id, side, value) of one form column."""
    entries = F.array(
        *[
            F.struct(
                F.lit(s.upper()).alias("side"),
                F.col(f"team_{s}").alias("team"),
                F.col(f"team_{s}_{column}").alias("value"),
            )
            for s in ("a", "b")
        ]
    )
    return features.select("contest_id", "ts", "tournament_order", F.explode(entries).alias("e")).select(
        "contest_id", "ts", "tournament_order", "e.*"
    )


def first_appearance_audit(features: DataFrame) -> DataFrame:
    """Teams whose first row already shows history: must be empty."""
    place = F.struct("ts", "tournament_order", "contest_id", "side")
    return (
        sides_of(features)
        .groupBy("team")
        .agg(
            F.min_by("value", place).alias("first_value"),
            F.min_by("contest_id", place).alias("contest_id"),
        )
        .filter(F.col("first_value") != 0)
    )


def same_time_audit(features: DataFrame) -> DataFrame:
    """(ts, team) with more than one prior count at the same moment: must be empty."""
    return (
        sides_of(features)
        .groupBy("ts", "team")
        .agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
        .filter(F.col("lowest") != F.col("highest"))
    )


def form_coverage(features: DataFrame, period: str = "tournament") -> DataFrame:
    """Rows, sides without history and mean history length per tournament."""
    a, b = F.col("team_a_prior_series_played"), F.col("team_b_prior_series_played")
    return features.groupBy(period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(a == 0).alias("team_a_zero_history"),
        F.count_if(b == 0).alias("team_b_zero_history"),
        F.avg(a).alias("mean_team_a_prior_series"),
        F.avg(b).alias("mean_team_b_prior_series"),
    )
