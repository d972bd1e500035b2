"""Names, rosters and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import rosters as r
from seriesmill.functions import text as t
from seriesmill.functions.timestamps import parse_display_timestamp
from seriesmill.operators import identity
from seriesmill.plans import views
from seriesmill.plans.catalog import register, stamp, stamp_sql
from seriesmill.plans.views_sql import CONTESTS, GAMES, IDENTITY, PLAYERS

# Aliases of the derived players; a user brings their own.
ALIASES = {"P0": "Zero", "P3": "P2", "p4": "Quattro"}


def _map_sql(key: str, other: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items())
    return f"case {key} {cases} else {other} end"


LOWER_CASES = " ".join(f"when '{k.lower()}' then '{v}'" for k, v in ALIASES.items())


@register(
    "alias_name",
    f"""with {PLAYERS}
select name, exact, ignoring, count(*) as n from (
  select ' ' || player || case when line = 1 then ' ' else '' end as name, {_map_sql('player', 'player')} as exact,
    case lower(player) {LOWER_CASES} else player end as ignoring from players) group by 1, 2, 3""",
)
def alias_name(spark, sf):
    name = F.concat(F.lit(" "), "player", F.when(F.col("line") == 1, " ").otherwise(""))
    named = views.players(spark, sf).select(name.alias("name"))
    return (
        named.select(
            "name",
            t.alias_name(F.col("name"), ALIASES).alias("exact"),
            t.alias_name(F.col("name"), ALIASES, ignore_case=True).alias("ignoring"),
        )
        .groupBy("name", "exact", "ignoring")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "alias_by_table",
    """select c_custkey, coalesce(n_name, c_mktsegment || (c_custkey % 30)) as label
from customer left join nation on n_nationkey || '' = cast(c_custkey % 30 as varchar)""",
)
def alias_by_table(spark, sf):
    """Aliases from a table: labels of customers replaced by nation names where there is one."""
    number = (F.col("c_custkey") % 30).cast("string")
    aliases = views.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("alias"), F.col("n_name").alias("name")
    )
    named = views.table(spark, sf, "customer").select(
        "c_custkey", number.alias("label"), F.concat("c_mktsegment", number).alias("own")
    )
    out = t.alias_by_table(named, "label", aliases)
    unchanged = F.col("label") == number.substr(1, 9)
    return out.select("c_custkey", F.when(unchanged, F.col("own")).otherwise(F.col("label")).alias("label"))


@register(
    "alias_team",
    f"""with {GAMES}
select game_id, case upper(blue_team) when 'P1_1' then 'ONE' when 'P2_2' then 'DUO' else upper(blue_team) end as team from games""",
)
def alias_team(spark, sf):
    return views.games(spark, sf).select(
        "game_id", t.alias_team(F.lower("blue_team"), {"p1_1": "ONE", "P2_2": "DUO"}).alias("team")
    )


@register(
    "canonical_key",
    """select p_partkey, regexp_replace(lower(trim(p_name || '_' || p_brand)), '[^a-z0-9]', '', 'g') as key from part""",
)
def canonical_key(spark, sf):
    label = F.concat("p_name", F.lit("_"), "p_brand")
    return views.table(spark, sf, "part").select("p_partkey", t.canonical_key(label).alias("key"))


ROSTER_TEXT = """
texts as (
  select game_id, case game_id % 4 when 0 then blue_players when 1 then replace(blue_players, '|', ' ; ')
    when 2 then replace(blue_players, '|', ',') else ' ' || replace(blue_players, '|', '| |') || '| ' end as roster
  from games)"""


def _roster_texts(spark, sf):
    blue, k = F.col("blue_players"), F.col("game_id") % 4
    text = (
        F.when(k == 0, blue)
        .when(k == 1, F.replace(blue, F.lit("|"), F.lit(" ; ")))
        .when(k == 2, F.replace(blue, F.lit("|"), F.lit(",")))
        .otherwise(F.concat(F.lit(" "), F.replace(blue, F.lit("|"), F.lit("| |")), F.lit("| ")))
    )
    return views.games(spark, sf).select("game_id", text.alias("roster"))


@register(
    "split_roster",
    f"""with {GAMES}, {ROSTER_TEXT}, parts as (
  select game_id, list_filter(list_transform(string_split_regex(trim(roster), case when contains(roster, '|') then '\\|'
    when contains(roster, ';') then ';' else ',' end), lambda x: trim(x)), lambda x: x <> '') as names from texts)
select game_id, array_to_string(names, '/') as names, len(names) as size,
  array_to_string(list_transform(names, lambda x: case lower(x) {LOWER_CASES} else x end), '/') as aliased from parts""",
)
def split_roster(spark, sf):
    roster = F.col("roster")
    return _roster_texts(spark, sf).select(
        "game_id",
        F.array_join(r.split_roster(roster), "/").alias("names"),
        F.size(r.split_roster(roster)).cast("long").alias("size"),
        F.array_join(r.split_roster(roster, ALIASES), "/").alias("aliased"),
    )


@register(
    "roster_signature",
    f"""with {PLAYERS}, l as (
  select game_id, list(case when line % 2 = 0 then lower(player) else player end) as names from players group by 1)
select game_id, array_to_string(list_sort(list_distinct(names)), '|') as by_code_point,
  array_to_string(list_transform(list_sort(list_transform(names, lambda x: lower(x) || '~' || x)),
    lambda x: split_part(x, '~', 2)), '|') as ignoring_case from l""",
)
def roster_signature(spark, sf):
    """Both orders of the same names: unique by code point, repeated ignoring case."""
    name = F.when(F.col("line") % 2 == 0, F.lower("player")).otherwise(F.col("player"))
    # A game has a handful of lines, one name each: counted names keep the list short.
    counted = views.players(spark, sf).groupBy("game_id", name.alias("name")).agg(F.count(F.lit(1)).alias("k"))
    repeated = F.flatten(
        F.transform(
            F.collect_list(F.struct("name", "k")), lambda e: F.array_repeat(e["name"], e["k"].cast("int"))
        )
    )
    return counted.groupBy("game_id").agg(repeated.alias("names")).select(
        "game_id",
        r.roster_signature(F.col("names")).alias("by_code_point"),
        r.roster_signature(F.col("names"), distinct=False, ignore_case=True).alias("ignoring_case"),
    )


@register(
    "matchup_fingerprint",
    f"""with {GAMES}
select game_id, case when game_id % 20 <> 0 then fingerprint end as fingerprint from games""",
)
def matchup_fingerprint(spark, sf):
    blue = F.when(F.col("game_id") % 20 != 0, F.col("blue_players"))
    return views.games(spark, sf).select(
        "game_id", r.matchup_fingerprint(F.col("orange_players"), blue).alias("fingerprint")
    )


@register(
    "unordered_pair",
    f"""with {GAMES}
select pair, count(*) as games from (select case when blue_team is not null and orange_team is not null then
  least(blue_team, orange_team) || ' vs ' || greatest(blue_team, orange_team) end as pair from games) group by 1""",
)
def unordered_pair(spark, sf):
    pair = r.unordered_pair(F.col("blue_team"), F.col("orange_team"))
    return views.games(spark, sf).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("games"))


@register(
    "blank_to_null",
    """select o_orderkey, nullif(trim(v), '') as trimmed,
  case when lower(trim(v)) in ('', 'nan', 'none', 'null', 'unknown', 'unknown team', 'unknown team names') then null
    else trim(v) end as name
from (select o_orderkey, case o_orderkey % 5 when 0 then '  ' when 1 then ' NaN' when 2 then 'Unknown Team '
  else ' ' || o_orderpriority || ' ' end as v from orders)""",
)
def blank_to_null(spark, sf):
    k = F.col("o_orderkey") % 5
    v = (
        F.when(k == 0, "  ")
        .when(k == 1, " NaN")
        .when(k == 2, "Unknown Team ")
        .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    )
    return views.table(spark, sf, "orders").select(
        "o_orderkey", t.blank_to_null(v).alias("trimmed"), t.valid_name(v).alias("name")
    )


@register(
    "to_double_lenient",
    """select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then null
  when 2 then o_custkey + 0.5::double when 3 then -o_custkey::double else null end as value from orders""",
)
def to_double_lenient(spark, sf):
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    text = (
        F.when(k == 0, "n/a")
        .when(k == 1, "NaN")
        .when(k == 2, F.concat(F.lit(" "), n, F.lit(".5 ")))
        .when(k == 3, F.concat(F.lit("-"), n))
        .otherwise(F.concat(n, F.lit("d")))
    )
    return views.table(spark, sf, "orders").select("o_orderkey", t.to_double_lenient(text).alias("value"))


@register(
    "to_utc_lenient",
    f"""select o_orderkey, case o_orderkey % 4 when 0 then {stamp_sql('o_orderdate')}
  when 1 then {stamp_sql('o_orderdate + interval 6 hour')} else null end as ts from orders""",
)
def to_utc_lenient(spark, sf):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(k == 0, F.concat(day, F.lit(" 00:00:00")))
        .when(k == 1, F.concat(day, F.lit("T00:00:00-06:00")))
        .when(k == 2, F.concat(day, F.lit(" 25:61")))
    )
    return views.table(spark, sf, "orders").select("o_orderkey", stamp(t.to_utc_lenient(text)).alias("ts"))


@register(
    "parse_display_timestamp",
    f"""select event_id, case event_id % 5 when 0 then {stamp_sql("date_trunc('minute', ts)")}
  when 1 then {stamp_sql("date_trunc('minute', ts) - interval 3 hour")}
  when 2 then {stamp_sql("date_trunc('minute', ts) + interval 6 hour")} else null end as utc,
  case event_id % 5 when 0 then 'explicit_utc' when 1 then 'explicit_offset_+03'
    when 2 then 'display_clock_assumed_-06' end as method from events""",
)
def display_timestamps(spark, sf):
    k, clock = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd HH:mm")
    text = (
        F.when(k == 0, F.concat(clock, F.lit(" UTC (2024-01-01 00:00 -06)")))
        .when(k == 1, F.concat(F.lit("("), clock, F.lit(" +03)")))
        .when(k == 2, clock)
        .when(k == 3, F.lit("n/a"))
    )
    return (
        views.table(spark, sf, "events")
        .select("event_id", parse_display_timestamp(text).alias("p"))
        .select("event_id", stamp("p.utc").alias("utc"), "p.method")
    )


@register(
    "unique_mapping",
    f"with {CONTESTS}, {IDENTITY} select tournament, roster, team from lookup",
)
def unique_mapping(spark, sf):
    names = identity.roster_names(views.contests(spark, sf))
    return identity.unique_mapping(names, ["tournament", "roster"], "team")


@register(
    "ambiguous_mapping",
    f"""with {CONTESTS}, {IDENTITY}
select tournament, roster, string_agg(team, ',' order by team) as teams
from (select distinct tournament, roster, team from seen) group by 1, 2 having count(*) > 1""",
)
def ambiguous_mapping(spark, sf):
    names = identity.roster_names(views.contests(spark, sf))
    out = identity.ambiguous_mapping(names, ["tournament", "roster"], "team")
    return out.select("tournament", "roster", F.array_join("values", ",").alias("teams"))


@register(
    "resolve_identity",
    f"""with {CONTESTS}, {IDENTITY}
select contest_id, team_a, team_b, team_a_source, team_b_source from resolved""",
)
def resolve_identity(spark, sf):
    return identity.resolve_identity(views.contests(spark, sf)).select(
        "contest_id", "team_a", "team_b", "team_a_source", "team_b_source"
    )
