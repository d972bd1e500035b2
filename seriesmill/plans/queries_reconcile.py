"""Metadata joins, official schedules and verified results."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.rosters import unordered_pair
from seriesmill.functions.rules import winner_from_goals
from seriesmill.operators import attach
from seriesmill.operators import reconcile as rec
from seriesmill.functions.text import canonical_key
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register, stamp, stamp_sql
from seriesmill.plans.queries_series import RECURSIVE, ROLLED, rolled
from seriesmill.plans.views_sql import CONTESTS, GAMES, HISTORY, PLAYERS

# One schedule row per pair that met; a pair led by its first team expects a game too many,
# a pair on a par is listed twice, and a clearly beaten first team has a twin that never met.
PAIRED = """
paired as (
  select *, case when blue_team is not null and orange_team is not null then
    least(blue_team, orange_team) || ' vs ' || greatest(blue_team, orange_team) end as pair,
    case when blue_goals > orange_goals then blue_team when orange_goals > blue_goals then orange_team end as game_winner
  from games),
met as (
  select pair, least(min(blue_team), min(orange_team)) as t1, greatest(max(blue_team), max(orange_team)) as t2,
    count(*) as n, count(*) filter (game_winner = least(blue_team, orange_team)) as first_wins,
    count(*) filter (game_winner = greatest(blue_team, orange_team)) as second_wins
  from paired where pair is not null group by 1),
schedule as (
  select pair || '#1' as id, t1 as team_a, t2 as team_b, n + case when first_wins > second_wins + 2 then 1 else 0 end as expected_games,
    t1 as winner, first_wins as winner_games, second_wins as loser_games from met
  union all
  select pair || '#2', t2, t1, n, t2, second_wins, first_wins from met where first_wins = second_wins
  union all
  select pair || '#3', t1, t2 || ' Academy', 3, t1, 3, 0 from met where second_wins > first_wins + 1)"""
MATCHED = """
per_pair as (
  select least(team_a, team_b) || ' vs ' || greatest(team_a, team_b) as pair, count(*) as k, min(id) as sid
  from schedule group by 1),
matched as (
  select p.*, case when p.pair is null then 'NO_TEAM_PAIR' when k is null then 'NO_SCHEDULE_MATCH'
    when k = 1 then 'MATCHED' else 'AMBIGUOUS' end as match_status, case when k = 1 then sid end as series_id
  from paired p left join per_pair q on q.pair = p.pair)"""


def _paired(spark, sf):
    blue, orange = F.col("blue_team"), F.col("orange_team")
    return (
        views.games(spark, sf)
        .withColumns(
            {
                "pair": unordered_pair(blue, orange),
                "game_winner": winner_from_goals(F.col("blue_goals"), F.col("orange_goals"), blue, orange),
            }
        )
    )


def _schedule(games):
    low, high = F.least("blue_team", "orange_team"), F.greatest("blue_team", "orange_team")
    met = (
        games.filter(F.col("pair").isNotNull())
        .groupBy("pair")
        .agg(
            F.min(low).alias("t1"),
            F.max(high).alias("t2"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("game_winner") == low).alias("w1"),
            F.count_if((F.col("game_winner") == high)).alias("w2"),
        )
    )

    def rows(suffix, a, b, expected, winner, won, lost):
        return F.struct(
            F.concat("pair", F.lit(suffix)).alias("id"),
            a.alias("team_a"),
            b.alias("team_b"),
            expected.cast("long").alias("expected_games"),
            winner.alias("winner"),
            won.cast("long").alias("winner_games"),
            lost.cast("long").alias("loser_games"),
        )

    t1, t2, n, w1, w2 = (F.col(c) for c in ("t1", "t2", "n", "w1", "w2"))
    extra = F.when(w1 > w2 + 2, 1).otherwise(0)
    entries = F.array(
        rows("#1", t1, t2, n + extra, t1, w1, w2),
        F.when(w1 == w2, rows("#2", t2, t1, n, t2, w2, w1)),
        F.when(
            w2 > w1 + 1, rows("#3", t1, F.concat(t2, F.lit(" Academy")), F.lit(3), t1, F.lit(3), F.lit(0))
        ),
    )
    return met.select(F.explode(entries).alias("s")).filter("s is not null").select("s.*")


def _matched(spark, sf):
    games = _paired(spark, sf)
    schedule = _schedule(games)
    return rec.reconcile_to_schedule(games, schedule), schedule


@register(
    "reconcile_to_schedule",
    f"with {GAMES}, {PAIRED}, {MATCHED} select game_id, match_status, series_id from matched",
)
def reconcile_to_schedule(spark, sf):
    return _matched(spark, sf)[0].select("game_id", "match_status", "series_id")


@register(
    "reconcile_unscheduled",
    f"""with {GAMES}, {PAIRED.replace('from met', "from met where first_wins >= second_wins", 1)}, {MATCHED}
select match_status, count(*) as games from matched group by 1""",
)
def reconcile_unscheduled(spark, sf):
    """Pairs whose first team is behind are left off the schedule: all four outcomes occur."""
    games = _paired(spark, sf)
    schedule = _schedule(games)
    behind = F.col("id").endswith("#1") & (F.col("winner_games") < F.col("loser_games"))
    listed = schedule.filter(~behind)
    out = rec.reconcile_to_schedule(games, listed)
    return out.groupBy("match_status").agg(F.count(F.lit(1)).alias("games"))


STATUS = """
statuses as (
  select s.id, team_a, team_b, expected_games, count(m.game_id) as actual_games,
    count(m.game_id) filter (m.game_winner = s.winner) as won, count(m.game_winner) as decided,
    any_value(winner_games) as wg, any_value(loser_games) as lg
  from schedule s left join matched m on m.series_id = s.id group by 1, 2, 3, 4),
status as (
  select id, team_a, team_b, expected_games, actual_games, case when actual_games = expected_games then 'COMPLETE'
    when actual_games = 0 then 'MISSING' else 'CHECK' end as status, won as winner_games_seen, decided - won as loser_games_seen,
    case when actual_games = 0 then 'NO_GAMES' when won = wg and decided - won = lg then 'CORRECT' else 'CHECK' end as winner_status
  from statuses)"""


@register("schedule_status", f"with {GAMES}, {PAIRED}, {MATCHED}, {STATUS} select * from status")
def schedule_status(spark, sf):
    matched, schedule = _matched(spark, sf)
    return rec.schedule_status(schedule, matched)


@register(
    "status_totals",
    f"with {GAMES}, {PAIRED}, {MATCHED}, {STATUS} select status, winner_status, count(*) as series from status group by 1, 2",
)
def status_totals(spark, sf):
    matched, schedule = _matched(spark, sf)
    return rec.status_totals(rec.schedule_status(schedule, matched))


@register(
    "reconciled_game_number",
    f"""with {GAMES}, {PAIRED}, {MATCHED}
select game_id, series_id, case when series_id is not null then row_number() over (partition by series_id order by ts, game_id) end as game_number
from matched""",
)
def reconciled_game_number(spark, sf):
    from seriesmill.operators.series import number_in_group

    out = number_in_group(_matched(spark, sf)[0], ["series_id"], "ts", "game_id")
    return out.select("game_id", "series_id", "game_number")


@register(
    "attach_metadata",
    f"""with {PLAYERS}, g as (select game_id, count(*) as lines from players group by 1)
select game_id, lines, {stamp_sql('o_orderdate')} as ts, o_orderpriority from g left join orders
  on o_orderkey = game_id and o_orderstatus <> 'F'""",
)
def attach_metadata(spark, sf):
    games = views.players(spark, sf).groupBy("game_id").agg(F.count(F.lit(1)).alias("lines"))
    games = games.withColumn("ts", F.lit("stale"))
    meta = (
        views.table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") != "F")
        .select(F.col("o_orderkey").alias("game_id"), stamp("o_orderdate").alias("ts"), "o_orderpriority")
    )
    return attach.attach_metadata(games, meta, "game_id", ["ts", "o_orderpriority"])


@register(
    "attach_both_sides",
    f"""with {PLAYERS}, s as (
  select game_id, color, avg(goals) as avg_goals, avg(line) as avg_line from players group by 1, 2),
c as (select game_id, 'blue' as team_a, 'orange' as team_b from players group by 1)
select c.game_id, team_a, team_b, {r6_sql('a.avg_goals')} as team_a_avg_goals, {r6_sql('a.avg_line')} as team_a_avg_line,
  {r6_sql('b.avg_goals')} as team_b_avg_goals, {r6_sql('b.avg_line')} as team_b_avg_line
from c left join s a on a.game_id = c.game_id and a.color = team_a left join s b on b.game_id = c.game_id and b.color = team_b""",
)
def attach_both_sides(spark, sf):
    from seriesmill.operators.games import team_means

    lines = views.players(spark, sf)
    stats = team_means(lines, ["goals", "line"], ["game_id", "color"]).withColumnRenamed("color", "team")
    contests = lines.select("game_id").distinct().withColumns({"team_a": F.lit("blue"), "team_b": F.lit("orange")})
    columns = ["avg_goals", "avg_line"]
    out = attach.attach_both_sides(contests, stats, "game_id", columns)
    return out.withColumns({f"team_{s}_{c}": r6(f"team_{s}_{c}") for s in "ab" for c in columns})


@register(
    "remove_listed",
    f"""with {GAMES} select game_id from games where game_id not in (select o_orderkey from orders where o_totalprice > 300000)""",
)
def remove_listed(spark, sf):
    listed = (
        views.table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 300000)
        .select(F.col("o_orderkey").alias("game_id"))
    )
    return attach.remove_listed(views.games(spark, sf), listed, "game_id").select("game_id")


@register(
    "keep_listed",
    f"""with {GAMES} select game_id from games where game_id in (select o_orderkey from orders where o_totalprice > 300000)""",
)
def keep_listed(spark, sf):
    listed = (
        views.table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 300000)
        .select(F.col("o_orderkey").alias("game_id"))
    )
    return attach.keep_listed(views.games(spark, sf), listed, "game_id").select("game_id")


@register(
    "overlay_constants",
    f"""with {GAMES} select game_id, case when o_totalprice > 300000 and c_mktsegment is not null then c_mktsegment else blue_team end as blue_team,
  orange_team from games join orders on o_orderkey = game_id left join customer on c_custkey = o_custkey""",
)
def overlay_constants(spark, sf):
    """Corrections for the games of expensive orders; their orange name stays."""
    fixes = (
        views.table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 300000)
        .join(views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("game_id"),
            F.col("c_mktsegment").alias("blue_team"),
            F.lit(None).cast("string").alias("orange_team"),
        )
    )
    games = views.games(spark, sf).select("game_id", "blue_team", "orange_team")
    return attach.overlay_constants(games, fixes, "game_id", ["blue_team", "orange_team"])


def _series(spark, sf):
    ident = F.concat_ws("~", "fingerprint", "stage", F.coalesce("subgroup", F.lit("-")), F.col("segment").cast("string"))
    return rolled(spark, sf).withColumn("series_id", ident)


SERIES_ID = "fingerprint || '~' || stage || '~' || coalesce(subgroup, '-') || '~' || segment"


def _verified(series):
    """Verified results for open series: the side that is ahead, else B, took it."""
    a, b = F.col("team_a_game_wins_observed"), F.col("team_b_game_wins_observed")
    need = F.col("wins_required")
    return series.filter(F.col("series_winner_side").isNull()).select(
        "series_id",
        F.col("team_a").alias("expected_team_a"),
        F.col("team_b").alias("expected_team_b"),
        F.when(a > b, need).otherwise(a).alias("completed_team_a_game_wins"),
        F.when(a > b, b).otherwise(need.cast("long")).alias("completed_team_b_game_wins"),
        F.when(a > b, "A").otherwise("B").alias("completed_series_winner_side"),
        F.lit("official_record").alias("result_source"),
    )


@register(
    "overlay_verified_results",
    f"""{RECURSIVE}, {ROLLED}, v as (
  select *, {SERIES_ID} as series_id, side is null as fixed, coalesce(side, case when aw > bw then 'A' else 'B' end) as final
  from rolled)
select series_id, final as series_winner_side, case when fixed then case final when 'A' then team_a else team_b end
    when final = 'A' then fa else fb end as series_winner,
  case final when 'A' then 1 else 0 end as target_team_a_win, fixed as result_reconciled,
  case when fixed then 'official_record' else 'observed_replays' end as result_source,
  case when fixed then case when aw > bw then wins_required else aw end end as completed_team_a_game_wins,
  aw as team_a_game_wins_observed from v""",
)
def overlay_verified_results(spark, sf):
    series = _series(spark, sf)
    return rec.overlay_verified_results(series, _verified(series)).select(
        "series_id",
        "series_winner_side",
        "series_winner",
        "target_team_a_win",
        "result_reconciled",
        "result_source",
        "completed_team_a_game_wins",
        "team_a_game_wins_observed",
    )


@register(
    "unknown_verified",
    """select o_orderkey as series_id, 0::bigint as rows from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select o_orderkey, count(*) from orders join lineitem on o_orderkey = l_orderkey group by 1 having count(*) > 1""",
)
def unknown_verified(spark, sf):
    series = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series_id"))
    verified = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("series_id"))
    return rec.unknown_verified(series, verified)


@register(
    "trusted_result_merge",
    f"""with {CONTESTS}
select count(*) as rows, count(*) filter (a_games + b_games = 7) as missing_results,
  count(*) filter (target is distinct from case when a_games + b_games <> 7 then
    case when a_games = 5 then 1 - target else target end end) as target_mismatches from contests""",
)
def trusted_result_merge(spark, sf):
    """A trusted table that lacks some contests and contradicts others."""
    contests = views.contests(spark, sf)
    flipped = F.when(F.col("a_games") == 5, 1 - F.col("target")).otherwise(F.col("target"))
    trusted = contests.filter(F.col("a_games") + F.col("b_games") != 7).select(
        "contest_id", "subgroup", flipped.alias("target"), "a_games", "b_games"
    )
    merged = rec.trusted_result_merge(
        contests, trusted, ["contest_id", "subgroup"], "target", ["a_games", "b_games"]
    )
    return rec.merge_problems(merged, "target", ["a_games", "b_games"])


ROSTER_STATS = ["career_games", "career_rating", "2024_rating"]
ROSTER_SQL = f"""with {CONTESTS}, {HISTORY}, shown as (
  select distinct unnest([team_a_players, team_b_players]) as roster from contests),
members as (select roster, unnest(string_split(roster, '|')) as player from shown),
rh as (
  select roster, count(*) as players_total, count(h.player_name) as players_matched,
    count(*) filter (career_games is not null or career_rating is not null or "2024_rating" is not null) as players_with_stats,
    avg(career_games) as career_games_mean, avg(career_rating) as career_rating_mean, avg("2024_rating") as "2024_rating_mean"
  from members left join history h on player_name = player group by 1)"""


def _history(spark, sf):
    return views.history(spark, sf).withColumnRenamed("player_name", "player")


def _roster_sides():
    plain = ["players_total", "players_matched", "players_with_stats"]
    out = []
    for s in "ab":
        out += [f"{s}.{c} as team_{s}_{c}" for c in plain]
        out.append(f"{r6_sql(f'{s}.players_with_stats / {s}.players_total')} as team_{s}_coverage")
        out += [f"{r6_sql(f'{s}.{chr(34)}{c}_mean{chr(34)}')} as team_{s}_{c}_mean" for c in ROSTER_STATS]
    out += [
        f"{r6_sql(f'a.{chr(34)}{c}_mean{chr(34)} - b.{chr(34)}{c}_mean{chr(34)}')} as diff_{c}" for c in ROSTER_STATS
    ]
    return ", ".join(out)


@register(
    "roster_history_features",
    f"""{ROSTER_SQL}
select contest_id, {_roster_sides()} from contests join rh a on a.roster = team_a_players join rh b on b.roster = team_b_players""",
)
def roster_history_features(spark, sf):
    contests = views.contests(spark, sf).select("contest_id", "team_a_players", "team_b_players")
    out = attach.roster_history_features(contests, _history(spark, sf), ROSTER_STATS)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: r6(F.col(f"`{c}`")) for c in doubles}).drop("team_a_players", "team_b_players")


@register(
    "unmatched_players",
    f"with {PLAYERS}, {HISTORY} select distinct player from players where player not in (select player_name from history)",
)
def unmatched_players(spark, sf):
    contests = views.contests(spark, sf).select("team_a_players", "team_b_players")
    return attach.unmatched_players(contests, _history(spark, sf))


@register(
    "roster_history_by_key",
    f"""{ROSTER_SQL}
select contest_id, {_roster_sides()} from contests join rh a on a.roster = team_a_players join rh b on b.roster = team_b_players""",
)
def roster_history_by_key(spark, sf):
    """The same from a history that spells names in its own way, in each file in another."""
    spelled = F.when(F.length("player") % 2 == 0, F.lower("player")).otherwise(F.concat(F.lit("-"), F.col("player"), F.lit(" !")))
    contests = views.contests(spark, sf).select("contest_id", "team_a_players", "team_b_players").repartition(7)
    history = _history(spark, sf).withColumn("player", spelled).repartition(5)
    out = attach.roster_history_features(contests, history, ROSTER_STATS, canonical_key)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: r6(F.col(f"`{c}`")) for c in doubles}).drop("team_a_players", "team_b_players")
