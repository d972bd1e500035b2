"""The derived contest tables as SQL, for the check in another engine."""

from __future__ import annotations

PLAYERS = """
players as (
  select l_orderkey as game_id, case when l_linenumber % 2 = 1 then 'blue' else 'orange' end as color,
         'P' || (l_suppkey % 6) as player, cast(floor(l_quantity) as bigint) as goals,
         cast(l_extendedprice as decimal(18,2)) as score, l_linenumber as line,
         l_discount as discount, l_tax as tax
  from lineitem)"""

GAMES = (
    PLAYERS
    + """,
rosters as (
  select game_id,
         list_sort(list_distinct(list(player) filter (color = 'blue'))) as br,
         list_sort(list_distinct(list(player) filter (color = 'orange'))) as orr,
         cast(sum(goals) filter (color = 'blue') % 6 as bigint) as blue_goals,
         cast(sum(goals) filter (color = 'orange') % 6 as bigint) as orange_goals,
         cast(sum(score) filter (color = 'blue') as double) as blue_score,
         cast(sum(score) filter (color = 'orange') as double) as orange_score
  from players group by game_id),
games0 as (
  select game_id, o_orderdate as ts,
         case when year(o_orderdate) <= 1996 then 1 when year(o_orderdate) <= 1998 then 2 else 3 end as tournament_order,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Playoff 1' else 'Group Stages' end as stage,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then null
              when o_custkey % 2 = 0 then 'Group A' else 'Group B' end as subgroup,
         array_to_string(br, '|') as blue_players, array_to_string(orr, '|') as orange_players,
         len(br) as blue_size, len(orr) as orange_size, blue_goals, orange_goals, blue_score, orange_score,
         case when game_id % 20 <> 0 then br[1] || '_' || len(br) ||
           case when br[1] = 'P0' then '_' || (game_id % 2) else '' end end as blue_team,
         case when game_id % 20 <> 10 then orr[1] || '_' || len(orr) ||
           case when orr[1] = 'P0' then '_' || (game_id % 2) else '' end end as orange_team
  from rosters join orders on game_id = o_orderkey
  where len(br) > 0 and len(orr) > 0 and br <> orr),
games as (
  select *, 'Open ' || tournament_order as tournament,
         least(blue_players, orange_players) || ' || ' || greatest(blue_players, orange_players) as fingerprint
  from games0)"""
)

ORIENTED = (
    GAMES
    + """,
oriented as (
  select *, least(blue_players, orange_players) as team_a_players,
         greatest(blue_players, orange_players) as team_b_players,
         case when blue_players < orange_players then 'blue' else 'orange' end as team_a_colour,
         case when blue_players < orange_players then blue_team else orange_team end as team_a,
         case when blue_players < orange_players then orange_team else blue_team end as team_b,
         case when blue_players < orange_players then blue_goals else orange_goals end as a_goals,
         case when blue_players < orange_players then orange_goals else blue_goals end as b_goals,
         case when blue_goals = orange_goals then null
              when (blue_goals > orange_goals) = (blue_players < orange_players) then 'A' else 'B' end as winner_side
  from games)"""
)

CONTESTS = (
    ORIENTED
    + """,
contests as (
  select game_id as contest_id, ts, tournament, tournament_order, stage, subgroup, team_a, team_b,
         team_a_players, team_b_players, a_goals as a_games, b_goals as b_games,
         case winner_side when 'A' then 1 when 'B' then 0 end as target
  from oriented)"""
)

IDENTITY = """
seen as (
  select tournament, team_a_players as roster, team_a as team from contests where team_a is not null
  union all
  select tournament, team_b_players, team_b from contests where team_b is not null),
lookup as (
  select tournament, roster, min(team) as team from seen group by 1, 2 having count(distinct team) = 1),
resolved as (
  select c.* exclude (team_a, team_b),
         coalesce(c.team_a, la.team, 'ROSTER::' || team_a_players) as team_a,
         coalesce(c.team_b, lb.team, 'ROSTER::' || team_b_players) as team_b,
         case when c.team_a is not null then 'stored_team_name'
              when la.team is not null then 'same_tournament_roster_lookup' else 'roster_fallback' end as team_a_source,
         case when c.team_b is not null then 'stored_team_name'
              when lb.team is not null then 'same_tournament_roster_lookup' else 'roster_fallback' end as team_b_source
  from contests c
  left join lookup la on la.tournament = c.tournament and la.roster = c.team_a_players
  left join lookup lb on lb.tournament = c.tournament and lb.roster = c.team_b_players)"""


def history_sql(source: str, windows: tuple[int, ...] = (3, 5)) -> str:
    """CTEs ``hist`` (team, ts, form) over a contest CTE named ``source``."""
    recent = "".join(
        f""",
         least(prior_series_played, {w}) as recent{w}_series_played,
         (select avg(won) from facts f where f.team = s.team and f.rn > s.prior_series_played - {w}
            and f.rn <= s.prior_series_played) as recent{w}_series_win_rate,
         (select case when count(rate) = count(*) then avg(rate) end from facts f where f.team = s.team
            and f.rn > s.prior_series_played - {w} and f.rn <= s.prior_series_played) as recent{w}_avg_game_win_rate"""
        for w in windows
    )
    return f"""
parts as (
  select contest_id, ts, tournament_order, 'A' as side, team_a as team, target as won, a_games as gw, b_games as gl
  from {source}
  union all
  select contest_id, ts, tournament_order, 'B', team_b, 1 - target, b_games, a_games from {source}),
facts as (
  select *, case when gw + gl > 0 then gw / (gw + gl) end as rate,
         row_number() over (partition by team order by ts, tournament_order, contest_id, side) as rn
  from parts where won is not null),
moments as (select distinct team, ts from parts),
sums as (
  select m.team, m.ts, count(f.won) as prior_series_played,
         cast(coalesce(sum(f.won), 0) as bigint) as prior_series_wins,
         count(f.won) - cast(coalesce(sum(f.won), 0) as bigint) as prior_series_losses,
         cast(coalesce(sum(f.gw), 0) as bigint) as prior_game_wins,
         cast(coalesce(sum(f.gl), 0) as bigint) as prior_game_losses,
         count(f.won) - coalesce(max(case when f.won = 0 then f.rn end), 0) as prior_series_win_streak
  from moments m left join facts f on f.team = m.team and f.ts < m.ts group by 1, 2),
hist as (
  select s.*, case when prior_series_played > 0 then prior_series_wins / prior_series_played end as prior_series_win_rate,
         case when prior_game_wins + prior_game_losses > 0
              then prior_game_wins / (prior_game_wins + prior_game_losses) end as prior_game_win_rate{recent}
  from sums s)"""


SESSIONS = """
sessions as (
  select event_id, event_type as stage, user_id % 3 as pair, ts from events)"""

PREDICTIONS = (
    GAMES
    + """,
decided as (
  select game_id as id, 'fold_' || (tournament_order - 1) as fold,
         cast(blue_goals > orange_goals as int) as target, *
  from games where blue_goals <> orange_goals and tournament_order >= 2),
predictions as (
  select id, fold, target, 'score_share' as model, blue_score / (blue_score + orange_score) as probability from decided
  union all
  select id, fold, target, 'size_share', blue_size / (blue_size + orange_size) from decided
  union all
  select id, fold, target, 'scramble', (game_id * 7919 % 1000) / 1000::double from decided)"""
)

HISTORY = """
history as (
  select player as player_name,
         case when player <> 'P4' then cast(count(*) as double) end as career_games,
         case when player <> 'P4' then avg(goals) end as career_rating,
         case when player <> 'P4' then avg(line) end as "2024_rating"
  from players where player <> 'P5' group by player)"""
