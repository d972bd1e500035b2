"""Games into series: by time gap, by roster, and by the number of wins that decide one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.rules import minutes_between, series_key, wins_required
from seriesmill.operators.ordering import bounds_up_to, cut, join_null_safe, previous, running_total, with_position
from seriesmill.sources.tables import written

CHUNK = 1024  # decided games walked at once where keys are large
FAN_IN = 128  # chunk functions folded in one array
DEPTH = 4  # levels of functions of functions
BITS = 12  # of a state code for the wins of one side
LOW = (1 << BITS) - 1  # most wins that may be needed; more are an error
STATE = (1 << 2 * BITS) - 1
CLOSED = 1 << 2 * BITS  # one closed segment in a state code


def sessionise(
    df: DataFrame, keys: list[str], ts: str, tiebreak: str, change: str, gap_minutes: float = 30.0
) -> DataFrame:
    """Session number per key: a new one when ``change`` differs or the gap is longer.

    Null keys form a group of their own. Adds previous value and time, minutes since.
    """
    made = previous(cut(df, keys, [ts, tiebreak]), [ts, change], "__previous")
    out = made.df.withColumns(
        {
            f"previous_{change}": F.col(f"__previous.{change}"),
            "previous_time": F.col(f"__previous.{ts}"),
            "minutes_since_previous": minutes_between(F.col(ts), F.col(f"__previous.{ts}")),
        }
    )
    begins = (
        F.col("__previous").isNull()
        | ~F.col(change).eqNullSafe(F.col(f"previous_{change}"))
        | (F.col("minutes_since_previous") > gap_minutes)
    )
    out = out.withColumn("new_session", begins.cast("int")).drop("__previous")
    return running_total(made.having(out), "new_session", "session").plain()


def candidate_summary(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Games, first and last time per candidate series."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )


def number_in_group(
    df: DataFrame, keys: list[str], ts: str, tiebreak: str, name: str = "game_number", null_keys: bool = False
) -> DataFrame:
    """Position of a game in its series; rows without a series get none unless asked."""
    numbered = with_position(df, keys, [ts, tiebreak], name)
    if null_keys:
        return numbered
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return numbered.withColumn(name, F.when(known, F.col(name)))


# --- segments that close when a side has won often enough --------------------------------
#
# Where a segment closes depends on all games before it. Of the games before a place only how
# many decided ones are in the open segment matters: their winners are known. So a run of
# games is a function of that length, which is at most 2 * need - 2: it gives the length after
# the run and how many segments closed. A key that fits in a piece is walked once from its
# start. A larger one is cut into chunks; their functions are composed in a tree, each chunk
# then starts from its true length, and only the places where segments end come out.


def _advance(code: Column, winner: Column, need: Column) -> Column:
    """State (segments closed, wins of A, wins of B) after one more game won by 1 (A) or 2 (B)."""
    a = F.shiftright(code, BITS).bitwiseAND(LOW) + F.when(winner == 1, 1).otherwise(0)
    b = code.bitwiseAND(LOW) + F.when(winner == 2, 1).otherwise(0)
    closed = code - code.bitwiseAND(STATE)
    return F.when((a >= need) | (b >= need), closed + CLOSED).otherwise(closed + F.shiftleft(a, BITS) + b)


def _checked(need: Column) -> Column:
    fault = F.raise_error(F.format_string("wins needed must be from 1 to %d, not %s", F.lit(LOW), need.cast("string")))
    return F.when(need.between(1, LOW), need).otherwise(fault.cast("long"))


def _code_of(last: Column) -> Column:
    """State of an open segment of these games."""
    return F.aggregate(last, F.lit(0).cast("long"), lambda acc, w: acc + F.when(w == 1, F.lit(1 << BITS)).otherwise(1))


def _opened(before: Column, need: Column) -> Column:
    """States in which a chunk may be entered, by length: a state has one game more of ``before``, from its end."""
    most = F.least(F.size(before), (2 * need - 2).cast("int"))
    return F.aggregate(
        F.when(most > 0, F.reverse(F.slice(before, -most, most))).otherwise(F.array().cast("array<int>")),
        F.array(F.lit(0).cast("long")),
        lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(w == 1, F.lit(1 << BITS)).otherwise(1))),
    )


def _length(code: Column) -> Column:
    """(segments closed, decided games of the open one) of a state."""
    wins = F.shiftright(code, BITS).bitwiseAND(LOW) + code.bitwiseAND(LOW)
    return code - code.bitwiseAND(STATE) + wins


def _apply(function: Column, code: Column) -> Column:
    """(closed, length) after ``function``; closed segments add up. A length no game leads to stays."""
    length = code.bitwiseAND(STATE)
    return code - length + F.coalesce(F.get(function, length.cast("int")), length)


def _entering(functions: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, id, code): segments closed before each chunk of a key, and the length it is entered with.

    At most FAN_IN functions meet in one array; ``depth`` levels of grouping lie above.
    """
    entry = F.struct("id", "function")
    if depth == 0:
        parents = functions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        parents = parents.withColumn("code", F.lit(0).cast("long"))
    else:
        grouped = functions.groupBy(*keys, F.floor(F.col("id") / FAN_IN).alias("parent")).agg(
            F.array_sort(F.collect_list(entry)).alias("entries")
        )
        lengths = F.transform(F.get("entries", F.lit(0))["function"], lambda _, i: i.cast("long"))
        composed = F.aggregate(
            "entries", lengths, lambda acc, e: F.transform(acc, lambda c: _apply(e["function"], c))
        )
        above = _entering(grouped.select(*keys, F.col("parent").alias("id"), composed.alias("function")), keys, depth - 1)
        parents = join_null_safe(
            grouped, above.select(*keys, F.col("id").alias("parent"), "code"), keys + ["parent"]
        )
    walked = F.aggregate(
        "entries",
        F.struct(F.col("code").alias("code"), F.array().cast("array<long>").alias("seen")),
        lambda acc, e: F.struct(
            _apply(e["function"], acc["code"]).alias("code"),
            F.concat(acc["seen"], F.array(acc["code"])).alias("seen"),
        ),
    )
    pairs = F.arrays_zip(F.transform("entries", lambda e: e["id"]).alias("id"), walked["seen"].alias("code"))
    return parents.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.id", "p.code")


def _ends(winners: Column, code: Column, first: Column, need: Column) -> Column:
    """Places of the decided games that close a segment; ``first`` is the place of the first one."""

    def closes(code: Column, w: Column) -> Column:
        return F.shiftright(_advance(code, w, need), 2 * BITS) > F.shiftright(code, 2 * BITS)

    walked = F.aggregate(
        winners,
        F.struct(code.alias("code"), first.cast("long").alias("at"), F.array().cast("array<long>").alias("ends")),
        lambda acc, w: F.struct(
            _advance(acc["code"], w, need).alias("code"),
            (acc["at"] + 1).alias("at"),
            F.when(closes(acc["code"], w), F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"]).alias("ends"),
        ),
    )
    return walked["ends"]


def _chunk_ends(decided: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, id, wide, closed, ends) of each chunk of ``wide`` decided games."""
    need = F.col("__need")
    wide = F.greatest(F.lit(chunk).cast("long"), 2 * need)
    chunks = (
        decided.withColumn("wide", wide)
        .groupBy(*keys, "__need", "wide", F.floor(F.col("__before") / F.col("wide")).alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("__before", "__winner"))).alias("games"))
    )
    chunks = written(chunks.withColumn("games", F.transform("games", lambda g: g["__winner"])), "chunks")
    # Only a full chunk has a successor, which needs the winners at its end.
    following = chunks.filter(F.size("games") == F.col("wide")).select(*keys, (F.col("id") + 1).alias("id"), F.col("games").alias("before"))
    both = join_null_safe(chunks, following, [*keys, "id"])
    opened = F.when(F.col("id") == 0, F.array(F.lit(0).cast("long"))).otherwise(_opened(F.coalesce("before", F.array().cast("array<int>")), need))
    left = F.aggregate("games", opened, lambda acc, w: F.transform(acc, lambda c: _advance(c, w, need)))
    # The first chunk is entered with nothing, whatever the length asked for.
    lengths = F.transform(left, _length)
    everywhere = F.array_repeat(F.get(lengths, F.lit(0)), (2 * need - 1).cast("int"))
    last = F.size("games") < F.col("wide")  # is entered, and leads nowhere
    function = F.when(last, F.array().cast("array<long>")).when(F.col("id") == 0, everywhere).otherwise(lengths)
    functions = both.select(*keys, "id", function.alias("function"))
    entered = join_null_safe(both, _entering(functions, keys, DEPTH), [*keys, "id"])
    code = F.coalesce("code", F.lit(0).cast("long"))
    length = code.bitwiseAND(STATE).cast("int")
    start = F.when(length == 0, F.lit(0).cast("long")).otherwise(_code_of(F.slice(F.col("before"), -length, length)))
    ends = _ends(F.col("games"), start, F.col("id") * F.col("wide"), need)
    return entered.select(*keys, "id", F.shiftright(code, 2 * BITS).alias("closed"), ends.alias("ends"))


def split_by_threshold(
    games: DataFrame,
    keys: list[str],
    ts: str,
    tiebreak: str,
    need: Column,
    winner: str = "winner_side",
    name: str = "segment",
    chunk: int | None = None,
) -> DataFrame:
    """Number the segments (from 1) inside each key.

    A segment closes at the game in which a side reaches ``need`` wins (a function of the
    keys, from 1 to ``LOW``; anything else is an error); both counters then restart. Undecided games belong to the open segment and
    count for nobody; a segment still open at the end is kept.

    Games meet as winners and places only; rows get their segment by place. A key is walked at
    once unless one is larger than a piece; then (or if ``chunk`` is given) keys are walked in chunks
    of ``chunk`` games, or 2 x need where that is more.
    """
    side = F.when(F.col(winner) == "A", 1).when(F.col(winner) == "B", 2)
    ready = games.withColumns({"__need": _checked(need.cast("long")), "__winner": side, "__one": side.isNotNull().cast("int")})
    ready = written(ready, "games")  # read by the count, the walk and the rows themselves
    made = running_total(cut(ready, keys, [ts, tiebreak]), "__one", "__before")
    numbered = made.df.withColumn("__before", F.col("__before") - F.col("__one"))
    decided = numbered.filter(F.col("__winner").isNotNull())
    if made.large or chunk:
        wide = F.greatest(F.lit(chunk or CHUNK).cast("long"), 2 * F.col("__need"))
        ends = _chunk_ends(decided.select(*keys, "__need", "__before", "__winner"), keys, chunk or CHUNK).withColumnRenamed("id", "__id")
        # An undecided game after the last one of a chunk belongs to that chunk.
        place = F.greatest(F.col("__before") - F.when(F.col("__winner").isNull(), 1).otherwise(0), F.lit(0))
        found = join_null_safe(numbered.withColumn("__id", F.floor(place / wide)), ends, [*keys, "__id"])
    else:
        walked = decided.groupBy(*keys, "__need").agg(F.array_sort(F.collect_list(F.struct("__before", "__winner"))).alias("games"))
        winners = F.transform("games", lambda g: g["__winner"])
        zero = F.lit(0).cast("long")
        ends = walked.select(*keys, zero.alias("closed"), _ends(winners, zero, zero, F.col("__need")).alias("ends"))
        found = join_null_safe(numbered, ends, keys)
    earlier = bounds_up_to(F.col("ends"), F.col("__before") - 1)
    segment = F.coalesce("closed", F.lit(0)) + earlier + 1
    return found.withColumn(name, segment.cast("long")).select(*games.columns, name)


def _one_or_first(name: str, order: Column) -> Column:
    """The only name seen, else the name of the first game, null included."""
    clean = F.nullif(F.trim(name), F.lit(""))
    return F.when(F.min(clean) == F.max(clean), F.min(clean)).otherwise(F.min_by(F.col(name), order))


def series_rollup_threshold(games: DataFrame, keys: list[str], ts: str = "ts", tiebreak: str = "game_id") -> DataFrame:
    """One row per segment; a winner only with the required wins and strictly more."""
    order = F.struct(ts, tiebreak)
    rolled = games.groupBy(*keys).agg(
        F.count_if(F.col("winner_side") == "A").alias("team_a_game_wins_observed"),
        F.count_if(F.col("winner_side") == "B").alias("team_b_game_wins_observed"),
        F.count(F.lit(1)).alias("replay_count"),
        F.min(ts).alias("series_start"),
        F.max(ts).alias("series_end"),
        F.min("team_a_players").alias("team_a_players"),
        F.min("team_b_players").alias("team_b_players"),
        _one_or_first("team_a", order).alias("team_a"),
        _one_or_first("team_b", order).alias("team_b"),
        F.min_by(F.col("team_a"), order).alias("__first_a"),
        F.min_by(F.col("team_b"), order).alias("__first_b"),
        F.bool_or("orientation_error").alias("orientation_error"),
        (
            (F.coalesce(F.min(F.trim("team_a")), F.lit("")) == F.coalesce(F.max(F.trim("team_a")), F.lit("")))
            & (F.coalesce(F.min(F.trim("team_b")), F.lit("")) == F.coalesce(F.max(F.trim("team_b")), F.lit("")))
        ).alias("team_name_consistency"),
    )
    return _decide(rolled.withColumn("wins_required", wins_required(F.col("stage"))), strict=True)


def _decide(rolled: DataFrame, strict: bool) -> DataFrame:
    a, b = F.col("team_a_game_wins_observed"), F.col("team_b_game_wins_observed")
    need = F.col("wins_required")
    enough = F.greatest(a, b) >= need
    side = F.when(a > b, "A").when(b > a, "B")
    out = rolled.withColumns(
        {
            "winner_reaches_required_wins": (enough & (a != b)) if strict else enough,
            "series_winner_side": F.when(enough, side) if strict else side,
        }
    )
    won = F.col("series_winner_side")
    first_a, first_b = ("__first_a", "__first_b") if strict else ("team_a", "team_b")
    return out.withColumns(
        {
            "series_winner": F.when(won == "A", F.col(first_a)).when(won == "B", F.col(first_b)),
            "target_team_a_win": F.when(won == "A", 1).when(won == "B", 0),
        }
    ).drop("__first_a", "__first_b")


def mode_name(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent known value per key; of equally frequent ones the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("__n"), F.col(value))).alias(name))


def series_rollup_anchor(games: DataFrame, keys: list[str], ts: str = "ts", tiebreak: str = "game_id") -> DataFrame:
    """One row per matchup, seen from the first game's blue side; most wins decide.

    ``games`` come from ``orient_by_first_game``. Ids of the games stay rows
    (``number_in_group``): as one text they could outgrow any task.
    """
    rolled = games.groupBy(*keys).agg(
        F.count_if(F.col("winner_side") == "A").alias("team_a_game_wins_observed"),
        F.count_if(F.col("winner_side") == "B").alias("team_b_game_wins_observed"),
        F.sum(F.when(F.col("b_goals").isNotNull(), F.col("a_goals"))).alias("team_a_goals_observed"),
        F.sum(F.when(F.col("a_goals").isNotNull(), F.col("b_goals"))).alias("team_b_goals_observed"),
        F.count(F.lit(1)).alias("replay_count"),
        F.min(ts).alias("series_start"),
        F.max(ts).alias("series_end"),
        F.min("team_a_players").alias("team_a_players"),
        F.min("team_b_players").alias("team_b_players"),
        F.min_by(
            F.col("stage"), F.when(F.col("stage").isNotNull(), F.struct(ts, tiebreak))
        ).alias("stage"),
        F.when(F.min("subgroup") == F.max("subgroup"), F.min("subgroup")).alias("subgroup"),
        F.bool_or("orientation_error").alias("orientation_error"),
    )
    for side in ("team_a", "team_b"):
        rolled = join_null_safe(rolled, mode_name(games, keys, side, side), keys)
    return _decide(rolled.withColumn("wins_required", wins_required(F.col("stage"))), strict=False)


def roster_series_summary(games: DataFrame, ts: str = "ts") -> DataFrame:
    """Earlier draft: one series per date and matchup, with every pair of names seen."""
    keyed = games.withColumn("series_key", series_key(F.col(ts), F.col("fingerprint")))
    main = keyed.groupBy("series_key").agg(
        F.min("fingerprint").alias("fingerprint"),
        F.count(F.lit(1)).alias("games"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
    )
    pairs = (
        keyed.filter(F.col("team_pair").isNotNull())
        .select("series_key", "team_pair")
        .distinct()
        .groupBy("series_key")
        .agg(F.array_join(F.array_sort(F.collect_list("team_pair")), "; ").alias("team_pairs"))
    )
    winners = mode_name(keyed, ["series_key"], "game_winner", "winner")
    return main.join(pairs, "series_key", "left").join(winners, "series_key", "left")


def chronological_series_id(
    series: DataFrame, period: str, prefix: Column, start: str, tiebreaks: list[str], width: int = 3
) -> DataFrame:
    """``series_number`` by first time inside each period, and the id made from it."""
    from seriesmill.functions.rules import format_series_id

    out = with_position(series, [period], [start, *tiebreaks], "series_number")
    return out.withColumn("series_id", format_series_id(prefix, F.col("series_number"), width))


def series_diagnostics(series: DataFrame) -> DataFrame:
    """The series a person should look at, each with its reasons."""
    n = F.col("replay_count")
    reasons = F.concat_ws(
        ",",
        F.when(~F.col("winner_reaches_required_wins"), "below_threshold"),
        F.when(F.col("orientation_error"), "orientation"),
        F.when(~F.col("team_name_consistency"), "names"),
        F.when((n < 3) | (n > 7), "game_count"),
        F.when(n.isin(1, 2, 6, 7), "unusual_count"),
    )
    return series.withColumn("reasons", reasons).filter(F.col("reasons") != "")


def unusual_games(matchups: DataFrame) -> DataFrame:
    """Games that are not three against three."""
    return matchups.filter((F.col("blue_player_count") != 3) | (F.col("orange_player_count") != 3))
