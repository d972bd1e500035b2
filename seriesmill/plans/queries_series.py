"""Series from games: sessions, rosters, thresholds, rollups, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.rosters import unordered_pair
from seriesmill.functions.rules import (
    format_series_id,
    is_playoff,
    minutes_between,
    series_key,
    winner_else_b,
    winner_from_goals,
    winner_from_score,
    wins_required,
)
from seriesmill.operators import games as g
from seriesmill.operators import series as s
from seriesmill.operators.ordering import with_position, with_previous
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register, stamp, stamp_sql
from seriesmill.plans.views_sql import GAMES, ORIENTED, PLAYERS, SESSIONS
from seriesmill.sources.tables import written

MATCHUP = ["fingerprint", "stage", "subgroup"]


# --- per-game building blocks -----------------------------------------------------------


@register(
    "player_matchups",
    f"""with {PLAYERS}, r as (
  select game_id, list_sort(list_distinct(list(player) filter (color = 'blue'))) as b,
         list_sort(list_distinct(list(player) filter (color = 'orange'))) as o from players group by 1),
t as (select game_id, coalesce(array_to_string(b, '|'), '') as bs, coalesce(array_to_string(o, '|'), '') as os,
             coalesce(len(b), 0) as bn, coalesce(len(o), 0) as onn from r)
select game_id, bs as blue_players, os as orange_players, bn as blue_player_count, onn as orange_player_count,
       case when bs <> '' and os <> '' then least(bs, os) || ' || ' || greatest(bs, os) end as fingerprint from t""",
)
def player_matchups(spark, sf):
    out = g.player_matchups(views.players(spark, sf))
    return out.withColumns({f"{c}_players": F.concat_ws("|", f"{c}_players") for c in g.COLOURS})


@register(
    "player_matchups_with_repeats",
    f"""with {PLAYERS}, named as (
  select game_id, color, case when line % 2 = 0 then lower(player) else player end as player from players),
r as (
  select game_id, list(player order by lower(player), player) filter (color = 'blue') as b,
         list(player order by lower(player), player) filter (color = 'orange') as o from named group by 1)
select game_id, coalesce(array_to_string(b, '|'), '') as blue_players,
  coalesce(array_to_string(o, '|'), '') as orange_players,
  coalesce(len(b), 0) as blue_player_count, coalesce(len(o), 0) as orange_player_count,
  case when len(b) > 0 and len(o) > 0 then least(array_to_string(b, '|'), array_to_string(o, '|')) || ' || ' ||
    greatest(array_to_string(b, '|'), array_to_string(o, '|')) end as fingerprint from r""",
)
def player_matchups_with_repeats(spark, sf):
    """Names in mixed case, repeats kept, order ignoring case."""
    mixed = F.when(F.col("line") % 2 == 0, F.lower("player")).otherwise(F.col("player"))
    out = g.player_matchups(views.players(spark, sf).withColumn("player", mixed), distinct=False)
    return out.withColumns({f"{c}_players": F.concat_ws("|", f"{c}_players") for c in g.COLOURS})


@register(
    "winner_rules",
    f"""with {GAMES}
select game_id, case when blue_goals > orange_goals then 'blue' when orange_goals > blue_goals then 'orange' end as by_goals,
  case when blue_score > orange_score then 'blue' when orange_score > blue_score then 'orange' else '' end as by_score,
  case when blue_goals > orange_goals then 1 else 0 end as else_b,
  case when stage = 'Group Stages' then 3 else 4 end as wins_required,
  case when stage = 'Playoff 1' then 1 else 0 end as is_playoff from games""",
)
def winner_rules(spark, sf):
    bg, og, bs, os = (F.col(f"{c}_{x}") for x in ("goals", "score") for c in g.COLOURS)
    blue, orange = F.lit("blue"), F.lit("orange")
    return views.games(spark, sf).select(
        "game_id",
        winner_from_goals(bg, og, blue, orange).alias("by_goals"),
        winner_from_score(bs, os, blue, orange).alias("by_score"),
        winner_else_b(bg, og, F.lit(1), F.lit(0)).alias("else_b"),
        wins_required(F.col("stage")).alias("wins_required"),
        is_playoff(F.col("stage")).alias("is_playoff"),
    )


WINNERS = """
winners as (
  select game_id, case when blue_score > orange_score then blue_team when orange_score > blue_score then orange_team else '' end as old,
         case when blue_goals > orange_goals then blue_team when orange_goals > blue_goals then orange_team end as new
  from games)"""


def _winners(spark, sf):
    bg, og, bs, os = (F.col(f"{c}_{x}") for x in ("goals", "score") for c in g.COLOURS)
    names = F.col("blue_team"), F.col("orange_team")
    return views.games(spark, sf).select(
        "game_id",
        winner_from_score(bs, os, *names).alias("old"),
        winner_from_goals(bg, og, *names).alias("new"),
    )


@register(
    "audit_changes",
    f"""with {GAMES}, {WINNERS}
select count(*) as rows, count(*) filter (old is distinct from new) as changed,
  count(*) filter (old is not null and new is null) as changed_to_null from winners""",
)
def audit_changes(spark, sf):
    return g.audit_changes(_winners(spark, sf), "old", "new")


@register("changed_rows", f"with {GAMES}, {WINNERS} select * from winners where old is distinct from new")
def changed_rows(spark, sf):
    return g.changed_rows(_winners(spark, sf), "old", "new")


ORIENT_COLUMNS = [
    "game_id",
    "team_a_players",
    "team_b_players",
    "team_a_colour",
    "team_a",
    "team_b",
    "a_goals",
    "b_goals",
    "winner_side",
]


@register("orient_lexicographic", f"with {ORIENTED} select {', '.join(ORIENT_COLUMNS)} from oriented")
def orient_lexicographic(spark, sf):
    return views.oriented_games(spark, sf).select(*ORIENT_COLUMNS)


ANCHORED = """
anchors as (
  select fingerprint, arg_min(blue_players, (ts, game_id)) as team_a_players,
         arg_min(orange_players, (ts, game_id)) as team_b_players from games group by 1),
anchored0 as (
  select g.*, a.team_a_players, a.team_b_players,
         case when blue_players = a.team_a_players then 'blue' else 'orange' end as team_a_colour
  from games g join anchors a using (fingerprint)),
anchored as (
  select *, case when team_a_colour = 'blue' then blue_team else orange_team end as team_a,
         case when team_a_colour = 'blue' then orange_team else blue_team end as team_b,
         case when team_a_colour = 'blue' then blue_goals else orange_goals end as a_goals,
         case when team_a_colour = 'blue' then orange_goals else blue_goals end as b_goals,
         case when blue_goals = orange_goals then null
              when (blue_goals > orange_goals) = (team_a_colour = 'blue') then 'A' else 'B' end as winner_side
  from anchored0)"""


def _anchored(spark, sf):
    return g.orient_by_first_game(views.games(spark, sf), ["fingerprint"], ["ts", "game_id"])


@register("orient_by_first_game", f"with {GAMES}, {ANCHORED} select {', '.join(ORIENT_COLUMNS)} from anchored")
def orient_by_first_game(spark, sf):
    return _anchored(spark, sf).select(*ORIENT_COLUMNS)


# --- sessions ---------------------------------------------------------------------------


@register(
    "lag_in_group",
    f"""with {SESSIONS}
select event_id, lag(pair) over w as previous_pair, epoch_us(lag(ts) over w) as previous_us
from sessions window w as (partition by stage order by ts, event_id)""",
)
def lag_in_group(spark, sf):
    out = with_previous(views.sessions(spark, sf), ["stage"], ["ts", "event_id"], ["ts", "pair"], "p")
    return out.select(
        "event_id", F.col("p.pair").alias("previous_pair"), F.unix_micros("p.ts").alias("previous_us")
    )


@register(
    "minutes_since",
    f"""with {SESSIONS}
select event_id, {r6_sql("(epoch_us(ts) - epoch_us(lag(ts) over (partition by stage order by ts, event_id))) / 6e7")} as minutes
from sessions""",
)
def minutes_since(spark, sf):
    out = with_previous(views.sessions(spark, sf), ["stage"], ["ts", "event_id"], ["ts"], "p")
    return out.select("event_id", r6(minutes_between(F.col("ts"), F.col("p.ts"))).alias("minutes"))


SESSIONISED = """
flagged as (
  select *, case when lag(pair) over w is distinct from pair or
    (epoch_us(ts) - epoch_us(lag(ts) over w)) / 6e7 > 30 then 1 else 0 end as new_session
  from sessions window w as (partition by stage order by ts, event_id)),
sessionised as (
  select *, cast(sum(new_session) over (partition by stage order by ts, event_id) as bigint) as session from flagged)"""


def _sessionised(spark, sf):
    return s.sessionise(views.sessions(spark, sf), ["stage"], "ts", "event_id", "pair")


@register("sessionise", f"with {SESSIONS}, {SESSIONISED} select event_id, new_session, session from sessionised")
def sessionise(spark, sf):
    return _sessionised(spark, sf).select("event_id", "new_session", "session")


@register(
    "candidate_summary",
    f"""with {SESSIONS}, {SESSIONISED}
select stage, session, count(*) as games, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us
from sessionised group by 1, 2""",
)
def candidate_summary(spark, sf):
    out = s.candidate_summary(_sessionised(spark, sf), ["stage", "session"])
    return out.select(
        "stage",
        "session",
        "games",
        F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"),
    )


@register(
    "candidate_size_histogram",
    f"""with {SESSIONS}, {SESSIONISED}
select games, count(*) as candidates from (select count(*) as games from sessionised group by stage, session) group by 1""",
)
def candidate_size_histogram(spark, sf):
    sizes = s.candidate_summary(_sessionised(spark, sf), ["stage", "session"])
    return sizes.groupBy("games").agg(F.count(F.lit(1)).alias("candidates"))


# --- threshold series -------------------------------------------------------------------

SEGMENTED = """
ordered as (
  select *, case when stage = 'Group Stages' then 3 else 4 end as need,
         row_number() over (partition by fingerprint, stage, subgroup order by ts, game_id) as pos from oriented),
walk as (
  select fingerprint, stage, subgroup, game_id, pos, 1::bigint as segment, need,
         case when winner_side = 'A' then 1 else 0 end as a, case when winner_side = 'B' then 1 else 0 end as b
  from ordered where pos = 1
  union all
  select o.fingerprint, o.stage, o.subgroup, o.game_id, o.pos,
         case when w.a >= w.need or w.b >= w.need then w.segment + 1 else w.segment end, o.need,
         case when w.a >= w.need or w.b >= w.need then 0 else w.a end + case when o.winner_side = 'A' then 1 else 0 end,
         case when w.a >= w.need or w.b >= w.need then 0 else w.b end + case when o.winner_side = 'B' then 1 else 0 end
  from walk w join ordered o on o.fingerprint = w.fingerprint and o.stage = w.stage
    and o.subgroup is not distinct from w.subgroup and o.pos = w.pos + 1),
segmented as (
  select o.*, w.segment from ordered o join walk w using (game_id))"""
RECURSIVE = f"with recursive {ORIENTED}, {SEGMENTED}"


def segmented(spark, sf, chunk=None):
    games = views.oriented_games(spark, sf).select(
        *MATCHUP,
        "game_id",
        "ts",
        "tournament",
        "tournament_order",
        "winner_side",
        "team_a",
        "team_b",
        "team_a_players",
        "team_b_players",
        "orientation_error",
    )
    return s.split_by_threshold(
        games,
        MATCHUP,
        "ts",
        "game_id",
        wins_required(F.col("stage")),
        chunk=chunk,
    )


@register("split_by_threshold", f"{RECURSIVE} select game_id, segment from segmented")
def split_by_threshold(spark, sf):
    return segmented(spark, sf).select("game_id", "segment")


@register("split_by_threshold_chunked", f"{RECURSIVE} select game_id, segment from segmented")
def split_by_threshold_chunked(spark, sf):
    """The same with chunks of 4 games, so that the composed path carries the load."""
    return segmented(spark, sf, chunk=4).select("game_id", "segment")


ROLLED = """
rolled0 as (
  select fingerprint, stage, subgroup, segment, count(*) filter (winner_side = 'A') as aw,
         count(*) filter (winner_side = 'B') as bw, count(*) as replay_count, min(ts) as series_start,
         max(ts) as series_end, any_value(need) as wins_required,
         arg_min(team_a, game_id) filter (first_game) as fa, arg_min(team_b, game_id) filter (first_game) as fb,
         count(distinct team_a) as na, count(distinct team_b) as nb, min(team_a) as ma, min(team_b) as mb,
         min(team_a_players) as team_a_players, min(team_b_players) as team_b_players
  from (select *, row_number() over (partition by fingerprint, stage, subgroup, segment order by ts, game_id) = 1
          as first_game from segmented)
  group by 1, 2, 3, 4),
rolled as (
  select *, case when na = 1 then ma else fa end as team_a, case when nb = 1 then mb else fb end as team_b,
         greatest(aw, bw) >= wins_required and aw <> bw as reached,
         case when greatest(aw, bw) >= wins_required and aw > bw then 'A'
              when greatest(aw, bw) >= wins_required and bw > aw then 'B' end as side,
         na <= 1 and nb <= 1 as consistent from rolled0)"""


def rolled(spark, sf):
    return s.series_rollup_threshold(segmented(spark, sf), MATCHUP + ["segment"])


@register(
    "series_rollup_threshold",
    f"""{RECURSIVE}, {ROLLED}
select fingerprint, stage, subgroup, segment, aw as team_a_game_wins_observed, bw as team_b_game_wins_observed,
  replay_count, {stamp_sql('series_start')} as series_start, {stamp_sql('series_end')} as series_end,
  team_a_players, team_b_players, team_a, team_b, false as orientation_error, consistent as team_name_consistency,
  wins_required, reached as winner_reaches_required_wins, side as series_winner_side,
  case side when 'A' then fa when 'B' then fb end as series_winner,
  case side when 'A' then 1 when 'B' then 0 end as target_team_a_win from rolled""",
)
def series_rollup_threshold(spark, sf):
    return rolled(spark, sf).withColumns({c: stamp(c) for c in ("series_start", "series_end")})


@register(
    "series_diagnostics",
    f"""{RECURSIVE}, {ROLLED}, why as (
  select fingerprint, stage, subgroup, segment, concat_ws(',', case when not reached then 'below_threshold' end,
    case when not consistent then 'names' end, case when replay_count < 3 or replay_count > 7 then 'game_count' end,
    case when replay_count in (1, 2, 6, 7) then 'unusual_count' end) as reasons from rolled)
select * from why where reasons <> ''""",
)
def series_diagnostics(spark, sf):
    return s.series_diagnostics(rolled(spark, sf)).select(*MATCHUP, "segment", "reasons")


@register(
    "series_size_histogram",
    f"{RECURSIVE}, {ROLLED} select stage, replay_count, count(*) as series from rolled group by 1, 2",
)
def series_size_histogram(spark, sf):
    return rolled(spark, sf).groupBy("stage", "replay_count").agg(F.count(F.lit(1)).alias("series"))


@register(
    "chronological_series_id",
    f"""{RECURSIVE}, s0 as (
  select tournament, fingerprint, stage, subgroup, segment, min(ts) as start from segmented group by all),
s1 as (select *, row_number() over (partition by tournament order by start, fingerprint, stage, subgroup nulls first, segment) as n from s0)
select tournament, fingerprint, stage, subgroup, segment, n as series_number,
  'O' || right(tournament, 1) || '_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as series_id
from s1""",
)
def chronological_series_id(spark, sf):
    starts = segmented(spark, sf).groupBy("tournament", *MATCHUP, "segment").agg(F.min("ts").alias("start"))
    prefix = F.concat(F.lit("O"), F.substring("tournament", -1, 1))
    return s.chronological_series_id(
        starts, "tournament", prefix, "start", [*MATCHUP, "segment"]
    ).drop("start")


@register(
    "number_in_group",
    f"""with {GAMES}, k as (select *, case when blue_team is not null then fingerprint end as series from games)
select game_id, case when series is not null then
  row_number() over (partition by series order by ts, game_id) end as game_number from k""",
)
def number_in_group(spark, sf):
    keyed = views.games(spark, sf).withColumn(
        "series", F.when(F.col("blue_team").isNotNull(), F.col("fingerprint"))
    )
    return s.number_in_group(keyed, ["series"], "ts", "game_id").select("game_id", "game_number")


@register(
    "number_with_null_group",
    f"""with {GAMES}
select game_id, row_number() over (partition by stage, subgroup order by ts, game_id) as game_number from games""",
)
def number_with_null_group(spark, sf):
    out = s.number_in_group(views.games(spark, sf), ["stage", "subgroup"], "ts", "game_id", null_keys=True)
    return out.select("game_id", "game_number")


# --- roster series ----------------------------------------------------------------------


def _mode_sql(column):
    return f"""(select fingerprint, arg_min({column}, (-n, {column})) as {column} from (
    select fingerprint, {column}, count(*) as n from anchored where {column} is not null group by 1, 2) group by 1)"""


@register(
    "series_rollup_anchor",
    f"""with {GAMES}, {ANCHORED}, base as (
  select fingerprint, count(*) filter (winner_side = 'A') as aw, count(*) filter (winner_side = 'B') as bw,
    cast(sum(a_goals) as bigint) as ag, cast(sum(b_goals) as bigint) as bg, count(*) as replay_count,
    min(ts) as st, max(ts) as en, min(team_a_players) as team_a_players, min(team_b_players) as team_b_players,
    arg_min(stage, (ts, game_id)) as stage, case when min(subgroup) = max(subgroup) then min(subgroup) end as subgroup
  from anchored group by 1),
w as (select *, case when aw > bw then 'A' when bw > aw then 'B' end as side,
             case when stage = 'Group Stages' then 3 else 4 end as need from base)
select fingerprint, aw as team_a_game_wins_observed, bw as team_b_game_wins_observed, ag as team_a_goals_observed,
  bg as team_b_goals_observed, replay_count, {stamp_sql('st')} as series_start, {stamp_sql('en')} as series_end,
  team_a_players, team_b_players, stage, subgroup, false as orientation_error, a.team_a, b.team_b,
  need as wins_required, greatest(aw, bw) >= need as winner_reaches_required_wins, side as series_winner_side,
  case side when 'A' then a.team_a when 'B' then b.team_b end as series_winner,
  case side when 'A' then 1 when 'B' then 0 end as target_team_a_win
from w left join {_mode_sql('team_a')} a using (fingerprint) left join {_mode_sql('team_b')} b using (fingerprint)""",
)
def series_rollup_anchor(spark, sf):
    out = s.series_rollup_anchor(_anchored(spark, sf), ["fingerprint"])
    return out.withColumns({c: stamp(c) for c in ("series_start", "series_end")})


@register(
    "series_members",
    f"""with {GAMES}
select fingerprint, game_id, row_number() over (partition by fingerprint order by ts, game_id) as game_number from games""",
)
def series_members(spark, sf):
    """The games of each roster series, in order, one row each."""
    out = s.number_in_group(views.games(spark, sf), ["fingerprint"], "ts", "game_id")
    return out.select("fingerprint", "game_id", "game_number")


@register(
    "roster_series_summary",
    f"""with {GAMES}, k as (
  select *, strftime(ts, '%Y-%m-%d') || ' | ' || fingerprint as series_key,
    least(blue_team, orange_team) || ' vs ' || greatest(blue_team, orange_team) as pair_text,
    blue_team is not null and orange_team is not null as both_known,
    case when blue_goals > orange_goals then blue_team when orange_goals > blue_goals then orange_team end as gw from games),
m as (select series_key, arg_min(gw, (-n, gw)) as winner from (
  select series_key, gw, count(*) as n from k where gw is not null group by 1, 2) group by 1),
p as (select series_key, string_agg(pair_text, '; ' order by pair_text) as team_pairs from (
  select distinct series_key, pair_text from k where both_known) group by 1)
select series_key, min(fingerprint) as fingerprint, count(*) as games, {stamp_sql('min(ts)')} as first_time,
  {stamp_sql('max(ts)')} as last_time, any_value(p.team_pairs) as team_pairs, any_value(m.winner) as winner
from k left join p using (series_key) left join m using (series_key) group by series_key""",
)
def roster_series_summary(spark, sf):
    blue, orange = F.col("blue_team"), F.col("orange_team")
    named = views.games(spark, sf).withColumns(
        {
            "team_pair": unordered_pair(blue, orange),
            "game_winner": winner_from_goals(F.col("blue_goals"), F.col("orange_goals"), blue, orange),
        }
    )
    out = s.roster_series_summary(named)
    return out.withColumns({c: stamp(c) for c in ("first_time", "last_time")})


@register(
    "series_key",
    f"""with {GAMES}, k as (
  select game_id, strftime(ts, '%Y-%m-%d') || ' | ' ||
    case when blue_team is null then 'UNKNOWN_MATCHUP' else fingerprint end as series_key from games)
select series_key, count(*) as games from k group by 1""",
)
def series_keys(spark, sf):
    known = F.when(F.col("blue_team").isNotNull(), F.col("fingerprint"))
    keyed = views.games(spark, sf).withColumn("series_key", series_key(F.col("ts"), known))
    return keyed.groupBy("series_key").agg(F.count(F.lit(1)).alias("games"))


@register(
    "format_series_id",
    """select o_orderkey, 'O' || (o_orderkey % 3) || '_' ||
  case when o_custkey < 1000 then lpad(o_custkey::varchar, 3, '0') else o_custkey::varchar end as series_id from orders""",
)
def format_ids(spark, sf):
    prefix = F.concat(F.lit("O"), (F.col("o_orderkey") % 3).cast("string"))
    return views.table(spark, sf, "orders").select(
        "o_orderkey", format_series_id(prefix, F.col("o_custkey")).alias("series_id")
    )


@register(
    "chronological_index",
    f"""with {GAMES}
select game_id, row_number() over (order by ts, tournament_order, game_id) as chronological_index from games""",
)
def chronological_index(spark, sf):
    out = with_position(
        written(views.games(spark, sf).select("game_id", "ts", "tournament_order"), "games"),
        [],
        ["ts", "tournament_order", "game_id"],
        "chronological_index",
    )
    return out.select("game_id", "chronological_index")


@register(
    "unusual_games",
    f"""with {PLAYERS}, r as (
  select game_id, count(distinct player) filter (color = 'blue') as blue_player_count,
    count(distinct player) filter (color = 'orange') as orange_player_count from players group by 1)
select * from r where blue_player_count <> 3 or orange_player_count <> 3""",
)
def unusual_games(spark, sf):
    out = s.unusual_games(g.player_matchups(views.players(spark, sf)))
    return out.select("game_id", "blue_player_count", "orange_player_count")


@register(
    "games_without_names",
    f"""with {GAMES} select game_id, blue_team, orange_team from games where blue_team is null or orange_team is null""",
)
def games_without_names(spark, sf):
    unknown = F.col("blue_team").isNull() | F.col("orange_team").isNull()
    return views.games(spark, sf).filter(unknown).select("game_id", "blue_team", "orange_team")
