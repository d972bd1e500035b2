"""From export files and fetched pages to typed rows.

The export files are texts that Spark writes out of the line items: four header layouts,
byte-order marks, quoted names, blanks, games with one colour or no player export.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.text import canonical_key
from seriesmill.operators import checks, games
from seriesmill.operators.games import AVERAGED, COLOURS, SUMMED
from seriesmill.operators.ordering import PIECE_ROWS, with_position
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register, stamp, stamp_sql
from seriesmill.plans.views_sql import GAMES, PLAYERS
from seriesmill.session import scratch_table
from seriesmill.sources import exports as x
from seriesmill.sources import stages, tables
from seriesmill.sources.pages import extract_page_fields

ROOT = "/raw"
NO_PLAYER_EXPORT = 50  # a game with a player of so many goals lacks its player export


def _by_layout(*options):
    chosen = F.when(F.col("layout") == 0, options[0])
    for i, o in enumerate(options[1:], 1):
        chosen = chosen.when(F.col("layout") == i, o)
    return chosen


def _line(*cells):
    return F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def _content(header, line):
    return F.concat_ws("\n", header, F.array_join(F.array_sort(F.collect_list(line)), "\n"))


def export_files(spark, sf):
    """(path, content) of one team and at most one player export per game."""
    lines = views.players(spark, sf).withColumn("layout", F.col("game_id") % 4)
    folder = (
        F.when(F.col("game_id") % 3 == 0, "Group Stages/Group A")
        .when(F.col("game_id") % 3 == 1, "Group Stages/Group B")
        .otherwise("Playoff 1")
    )

    def path(ending):
        return F.concat(F.lit(ROOT + "/"), folder, F.lit("/"), F.col("game_id").cast("string"), ending)

    sides = lines.groupBy("game_id", "layout", "color").agg(
        F.sum("goals").alias("goals"), F.sum("score").alias("score")
    )
    k = (F.col("game_id") % 7).cast("string")
    name = F.when(F.col("game_id") % 20 == 0, "").otherwise(F.concat("color", F.lit("_"), k))
    quoted = F.concat(F.lit('"'), "color", F.lit(";"), k, F.lit('"'))
    team_line = _by_layout(
        _line(F.col("color"), name, F.col("score"), F.col("goals"), F.lit("300")),
        _line(F.col("goals"), F.col("color"), name, F.col("score")),
        _line(F.col("color"), name, F.col("goals")),
        _line(F.col("color"), quoted, F.col("score"), F.col("goals"), F.lit("300")),
    )
    team_header = _by_layout(
        F.lit("color;team name;score;goals;game duration"),
        F.lit("\ufeffGoals;Color; Team Name ;Score"),
        F.lit("team color;name;goals"),
        F.lit("color;team name;score;goals;game duration"),
    )
    team = sides.groupBy("game_id", "layout").agg(F.array_join(F.array_sort(F.collect_list(team_line)), "\n").alias("t"))
    team = team.select(
        path(F.when(F.col("layout") == 2, "_team.csv").otherwise("-teams.csv")).alias("path"),
        F.concat_ws("\n", team_header, "t").alias("content"),
    )
    demos = F.when(F.col("line") % 3 != 0, F.col("line"))
    c, p, n = F.col("color"), F.col("player"), F.col("goals")
    player_line = _by_layout(
        _line(c, p, n, F.col("line"), F.col("discount"), F.col("tax"), n, demos),
        _line(p, F.concat(c, F.lit("-club")), F.col("discount"), n, demos, c, F.col("line"), F.col("tax"), n),
        _line(c, p, n, F.col("line"), F.col("discount"), demos),
        _line(c, p, n, F.col("line"), F.col("discount"), F.col("tax"), n, demos),
    )
    player_header = _by_layout(
        F.lit("color;player name;goals;assists;shooting %;bpm;avg boost amount;demos taken"),
        F.lit("player name;team;shooting percentage;goals;demos received;color;assists;bpm;average boost"),
        F.lit("\ufeffTeam Color;Player;Goals;Assists;Shooting_Percentage;demos_taken"),
        F.lit("color;player name;goals;assists;shooting %;bpm;avg boost amount;demos taken"),
    )
    player = (
        lines.groupBy("game_id", "layout")
        .agg(
            F.array_join(F.array_sort(F.collect_list(player_line)), "\n").alias("t"),
            F.max("goals").alias("top"),
        )
        .filter(F.col("top") < NO_PLAYER_EXPORT)
        .select(
            path(F.when(F.col("layout") == 2, "_player.csv").otherwise("-players.csv")).alias("path"),
            F.concat_ws("\n", player_header, "t").alias("content"),
        )
    )
    return team.unionByName(player)


def parsed(spark, sf):
    return x.parse_exports(x.with_path_fields(export_files(spark, sf), ROOT))


FOLDER = """case game_id % 3 when 0 then 'Group Stages/Group A' when 1 then 'Group Stages/Group B' else 'Playoff 1' end"""
SIDES = (
    PLAYERS
    + """,
sides as (
  select game_id, color, sum(goals)::double as goals, sum(score)::double as score, sum(line)::double as assists,
    avg(discount) as shooting_percentage, case when game_id % 4 <> 2 then avg(tax) end as bpm,
    case when game_id % 4 <> 2 then avg(goals) end as avg_boost,
    sum(case when line % 3 <> 0 then line end)::double as demos_taken, count(*) as n, max(goals) as top,
    case when game_id % 4 = 3 then color || ';' || (game_id % 7) when game_id % 20 = 0 then null
      else color || '_' || (game_id % 7) end as team_file,
    case when game_id % 4 = 1 then color || '-club' end as team_players
  from players group by game_id, color)"""
)
FILLED = ("goals", "assists", "shooting_percentage", "bpm", "avg_boost", "demos_taken")


@register(
    "path_fields",
    f"""with {PLAYERS}, g as (select game_id, max(goals) as top from players group by 1), f as (
  select game_id, 'team' as kind, case when game_id % 4 = 2 then '_team.csv' else '-teams.csv' end as ending from g
  union all
  select game_id, 'player', case when game_id % 4 = 2 then '_player.csv' else '-players.csv' end from g where top < 50)
select kind, game_id || '' as replay_id, {FOLDER} as folder, {FOLDER} || '/' || game_id || ending as source_file,
  case when game_id % 3 = 2 then 'Playoff 1' else 'Group Stages' end as stage,
  case game_id % 3 when 0 then 'Group A' when 1 then 'Group B' end as subgroup from f""",
)
def path_fields(spark, sf):
    out = x.with_path_fields(export_files(spark, sf), ROOT)
    return out.select("kind", "replay_id", "folder", "source_file", "stage", "subgroup")


@register(
    "pair_files",
    f"""with {PLAYERS}, g as (select game_id, max(goals) as top from players group by 1)
select {FOLDER} as folder, game_id || '' as replay_id,
  {FOLDER} || '/' || game_id || case when game_id % 4 = 2 then '_team.csv' else '-teams.csv' end as team_file,
  case when top < 50 then {FOLDER} || '/' || game_id ||
    case when game_id % 4 = 2 then '_player.csv' else '-players.csv' end end as player_file,
  case when top < 50 then 1::bigint end as player_files from g""",
)
def pair_files(spark, sf):
    return x.pair_files(x.with_path_fields(export_files(spark, sf), ROOT))


@register(
    "parse_exports",
    f"""with {PLAYERS}
select game_id || '' as replay_id, color, player, case when game_id % 4 = 1 then color || '-club' end as team,
  goals::double as goals, line::double as assists, discount as shooting_percentage,
  case when game_id % 4 <> 2 then tax end as bpm, case when game_id % 4 <> 2 then goals::double end as avg_boost,
  case when line % 3 <> 0 then line::double end as demos_taken, null::double as saves
from players where game_id not in (select game_id from players where goals >= 50)""",
)
def parse_exports(spark, sf):
    rows = x.player_stats(parsed(spark, sf).filter(F.col("kind") == "player"))
    return rows.select("replay_id", "color", "player", "team", *FILLED, "saves")


@register(
    "quarantine_exports",
    f"""with {SIDES}, g as (
  select game_id, count(*) as rows, max(top) as top from sides group by 1)
select {FOLDER} as folder, game_id || '' as replay_id,
  case when game_id % 4 = 2 then 'missing_columns' when rows <> 2 then 'team_rows_not_2'
    when top >= 50 then 'no_player_export' end as reject_reason from g""",
)
def quarantine_exports(spark, sf):
    return x.reject_reasons(parsed(spark, sf), ["color", "team name", "score", "goals"])


def _sides_sql():
    out = []
    for c in COLOURS:
        for s in SUMMED + AVERAGED:
            out.append(
                f"{r6_sql(f'{c[0]}.{s}')} as {c}_{s}" if s in FILLED else f"null::double as {c}_{s}"
            )
    return ", ".join(out)


@register(
    "game_rows",
    f"""with {SIDES}, b as (select * from sides where color = 'blue'), o as (select * from sides where color = 'orange'),
g as (select game_id from sides group by 1 having max(top) < 50 and count(*) = 2)
select game_id || '' as replay_id, case when game_id % 3 = 2 then 'Playoff 1' else 'Group Stages' end as stage,
  case game_id % 3 when 0 then 'Group A' when 1 then 'Group B' end as subgroup,
  {FOLDER} || '/' || game_id || case when game_id % 4 = 2 then '_team.csv' else '-teams.csv' end as source_team_file,
  coalesce(b.team_file, b.team_players) as blue_team, coalesce(o.team_file, o.team_players) as orange_team,
  {r6_sql("case when game_id % 4 = 2 then b.goals else b.score end")} as blue_score,
  {r6_sql("case when game_id % 4 = 2 then o.goals else o.score end")} as orange_score,
  case when game_id % 4 in (0, 3) then '300' end as game_duration, {_sides_sql()},
  case when b.goals > o.goals then coalesce(b.team_file, b.team_players)
       when o.goals > b.goals then coalesce(o.team_file, o.team_players) end as game_winner
from g left join b using (game_id) left join o using (game_id)""",
)
def game_rows(spark, sf):
    """All exports into the 45-column game table."""
    out = x.game_rows(parsed(spark, sf))
    numeric = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: r6(c) for c in numeric})


@register(
    "aggregate_sides",
    f"""with {PLAYERS}
select game_id, cast(sum(goals) filter (color = 'blue') as bigint) as blue_goals,
  cast(sum(goals) filter (color = 'orange') as bigint) as orange_goals,
  {r6_sql("avg(discount) filter (color = 'blue')")} as blue_bpm,
  {r6_sql("avg(discount) filter (color = 'orange')")} as orange_bpm from players group by 1""",
)
def aggregate_sides(spark, sf):
    stats = views.players(spark, sf).withColumn("bpm", F.col("discount"))
    missing = [s for s in SUMMED + AVERAGED if s not in ("goals", "bpm")]
    stats = stats.withColumns({s: F.lit(None).cast("double") for s in missing})
    out = games.aggregate_sides(stats)
    return out.select("game_id", "blue_goals", "orange_goals", *[r6(f"{c}_bpm").alias(f"{c}_bpm") for c in COLOURS])


@register(
    "aggregate_sides_from_team_rows",
    f"""with {SIDES}
select game_id, max(goals) filter (color = 'blue') as blue_goals, max(goals) filter (color = 'orange') as orange_goals
from sides group by 1""",
)
def aggregate_sides_from_team_rows(spark, sf):
    team = views.players(spark, sf).groupBy("game_id", "color").agg(F.sum("goals").cast("double").alias("goals"))
    missing = [s for s in SUMMED + AVERAGED if s != "goals"]
    team = team.withColumns({s: F.lit(None).cast("double") for s in missing})
    return games.aggregate_sides(team, source="team").select("game_id", "blue_goals", "orange_goals")


@register(
    "team_means",
    f"""with {PLAYERS}
select game_id, color, {r6_sql('avg(goals)')} as avg_goals, {r6_sql('avg(line)')} as avg_line,
  {r6_sql('avg(discount)')} as avg_discount from players group by 1, 2""",
)
def team_means(spark, sf):
    stats = ["goals", "line", "discount"]
    out = games.team_means(views.players(spark, sf), stats, ["game_id", "color"])
    return out.withColumns({f"avg_{s}": r6(f"avg_{s}") for s in stats})


@register(
    "colour_to_team",
    f"""with {PLAYERS}, t as (select game_id, color, arg_max(player || '_' || line, (line, player)) as team from players group by 1, 2)
select game_id, player, team, count(*) as rows from players join t using (game_id, color) group by 1, 2, 3""",
)
def colour_to_team(spark, sf):
    """The team rows repeat a colour: the last one names all its players."""
    lines = views.players(spark, sf)
    teams = lines.select(
        "game_id",
        "color",
        F.concat("player", F.lit("_"), F.col("line").cast("string")).alias("team"),
        F.struct("line", "player").alias("row_no"),
    )
    out = games.colour_to_team(lines.select("game_id", "color", "player"), teams)
    return out.groupBy("game_id", "player", "team").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "drop_all_null_columns",
    """select c_custkey, c_name, case when c_custkey % 7 = 0 then c_acctbal end as sometimes from customer""",
)
def drop_all_null_columns(spark, sf):
    df = views.table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal")).alias("sometimes"),
        F.when(F.col("c_custkey") < 0, F.col("c_acctbal")).alias("never"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return checks.drop_all_null_columns(df)


PAGE_SQL = f"""with src as (
  select page_id, url, html, case page_id % 4 when 0 then '2024-01-0' || (page_id % 9 + 1) || ' 10:15'
    when 1 then '2024-01-0' || (page_id % 9 + 1) || ' 10:15 UTC (x)' when 2 then 'unknown' end as shown from pages),
t as (select *, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
    '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as title from src)
select page_id,
  replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
    '&nbsp;', ' '), '&amp;', '&') as page_title,
  shown as replay_date_raw, md5(url) as match_guid, 'EU-' || (page_id % 5) as server,
  case page_id % 4 when 0 then '2024-01-0' || (page_id % 9 + 1) || ' 16:15:00'
    when 1 then '2024-01-0' || (page_id % 9 + 1) || ' 10:15:00' end as replay_timestamp_utc,
  case page_id % 4 when 0 then 'display_clock_assumed_-06' when 1 then 'explicit_utc' end as timestamp_method,
  page_id % 4 < 2 as scrape_success,
  case page_id % 4 when 3 then 'replay_date_tag_not_found' when 2 then 'replay_date_parse_failed' end as error from t"""


@register("extract_page_fields", PAGE_SQL)
def page_fields(spark, sf):
    """Whole pages, with a replay block appended that differs from page to page."""
    k = F.col("page_id") % 4
    day = F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"))
    shown = (
        F.when(k == 0, F.concat(day, F.lit(" 10:15")))
        .when(k == 1, F.concat(day, F.lit(" 10:15 UTC (x)")))
        .when(k == 2, "unknown")
    )
    block = F.concat(
        F.coalesce(
            F.concat(F.lit('<span class="d" title="When the game took place"><b>'), shown, F.lit("</b></span>")),
            F.lit(""),
        ),
        F.lit("<p>MatchGUID: "),
        F.md5("url"),
        F.lit("</p><!-- Server: none --><p>Server:&nbsp;EU-"),
        (F.col("page_id") % 5).cast("string"),
        F.lit("</p>"),
    )
    pages = views.table(spark, sf, "pages").select("page_id", F.concat("html", block).alias("html"))
    return (
        extract_page_fields(pages)
        .withColumn("replay_timestamp_utc", stamp("replay_timestamp_utc"))
        .drop("html")
    )


@register(
    "keys_to_fetch",
    """select distinct user_id::varchar as user_id from events
where user_id::varchar not in (select user_id::varchar from events where event_type = 'signup' and value > 90)""",
)
def keys_to_fetch(spark, sf):
    log = views.table(spark, sf, "events").select("user_id", "event_type", "value")
    done = log.filter((F.col("event_type") == "signup") & (F.col("value") > 90))
    return tables.keys_to_fetch(log, "user_id", done)


@register(
    "distinct_keys",
    "select distinct user_id::varchar as user_id from events where user_id is not null",
)
def distinct_keys(spark, sf):
    return tables.keys_to_fetch(views.table(spark, sf, "events"), "user_id")


@register(
    "upsert_latest",
    """select user_id, event_id, event_type from events
qualify row_number() over (partition by user_id order by event_id desc) = 1""",
)
def upsert_latest(spark, sf):
    log = views.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    old, new = log.filter(F.col("event_type") != "error"), log.filter(F.col("event_type") == "error")
    return tables.upsert_latest(old, new, "user_id", "event_id")


@register(
    "player_history",
    f"""with {PLAYERS}
select player, max(goals)::double as career_games, null::double as career_rating from players group by 1""",
)
def player_history(spark, sf):
    raw = views.players(spark, sf).select(
        F.concat(F.lit(" "), "player").alias("player_name"), F.col("goals").cast("string").alias("career_games")
    )
    return tables.player_history(raw).select("player", "career_games", "career_rating")


@register(
    "write_stage",
    f"""with {GAMES} select tournament, stage, count(*) as games, cast(sum(blue_goals) as bigint) as goals
from games where tournament_order >= 2 group by 1, 2""",
)
def write_stage(spark, sf):
    """Games written by tournament into the shared folder, read back with pruning."""
    path = scratch_table(spark, "games")
    columns = ["game_id", "stage", "blue_goals", "tournament", "tournament_order"]
    tables.write_stage(views.games(spark, sf), path, columns, partition_by=["tournament"])
    back = spark.read.parquet(path).filter(F.col("tournament").isin("Open 2", "Open 3"))
    return back.groupBy("tournament", "stage").agg(
        F.count(F.lit(1)).alias("games"), F.sum("blue_goals").alias("goals")
    )


@register(
    "quarantine_rows",
    f"""with {GAMES}
select game_id, case when blue_team is null or orange_team is null then 'no_team_name'
  when blue_goals = orange_goals then 'no_winner' end as reject_reason from games""",
)
def quarantine_rows(spark, sf):
    rules = {
        "no_team_name": F.col("blue_team").isNull() | F.col("orange_team").isNull(),
        "no_winner": F.col("blue_goals") == F.col("orange_goals"),
    }
    return checks.quarantine(views.games(spark, sf), rules).select("game_id", "reject_reason")


# --- real files ---------------------------------------------------------------------------
#
# A game per supplier: its lines are two sides (by status) of players (by flag and line number).
# Its two exports are files in folders whose names have blanks; some are spoiled.

LINES = """
lines as (
  select l_suppkey as game_id, case l_linestatus when 'O' then 'blue' else 'orange' end as color,
    l_returnflag || l_linenumber as player, cast(l_quantity as bigint) as quantity from lineitem),
side as (
  select game_id, color, count(*) as goals, sum(quantity) as score, color || case when game_id % 4 = 2 then '; ' else '_' end || game_id % 7 as team
  from lines group by 1, 2),
faults as (
  select distinct game_id, case when game_id % 11 = 3 then 'not_utf8' when game_id % 13 = 4 then 'parse_failed' when game_id % 17 = 5 then 'ragged_rows' end as fault from lines)"""


def _export_lines(spark, sf):
    line = views.table(spark, sf, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("game_id"),
        F.when(F.col("l_linestatus") == "O", "blue").otherwise("orange").alias("color"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("player"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def written_exports(spark, sf):
    """Team and player files of every supplier below a folder of their own, and that folder."""
    lines = _export_lines(spark, sf).withColumn("layout", F.col("game_id") % 4)
    goals = F.count(F.lit(1)).alias("goals")
    side = lines.groupBy("game_id", "layout", "color").agg(goals, F.sum("quantity").alias("score"))
    k = (F.col("game_id") % 7).cast("string")
    name = F.when(F.col("layout") == 2, F.concat(F.lit('"'), "color", F.lit("; "), k, F.lit('"'))).otherwise(F.concat("color", F.lit("_"), k))
    plain = "color;team name;score;goals;game duration"
    team = side.withColumn(
        "line",
        _by_layout(
            _line(F.col("color"), name, F.col("score"), F.col("goals"), F.lit("300")),
            _line(F.col("goals"), F.lit(""), F.col("color"), name, F.col("score")),
            _line(F.col("color"), name, F.col("score"), F.col("goals"), F.lit("300")),
            _line(F.col("score"), F.col("goals"), name, F.upper("color")),
        ),
    )
    team_head = _by_layout(F.lit(plain), F.lit("\ufeffGoals;;Color; Team Name ;Score"), F.lit(plain), F.lit("SCORE;goals;TEAM NAME;color"))
    players = lines.groupBy("game_id", "layout", "color", "player").agg(goals, F.sum("quantity").alias("assists"))
    c, p, n, a = (F.col(x) for x in ("color", "player", "goals", "assists"))
    player = players.withColumn("line", _by_layout(_line(c, p, n, a), _line(p, c, a, n), _line(c, p, n, a), _line(a, n, p, c)))
    player_head = _by_layout(F.lit("color;player name;goals;assists"), F.lit("\ufeffPlayer;team color;Assists;Goals"), F.lit("color;player name;goals;assists"), F.lit("assists;goals;name;color"))

    def files(rows, head, ending):
        whole = rows.groupBy("game_id", "layout").agg(F.array_join(F.array_sort(F.collect_list("line")), "\r\n").alias("body"))
        return whole.select("game_id", F.concat(F.col("game_id").cast("string"), F.lit(ending)).alias("file"), F.concat_ws("\r\n", head, "body").alias("value"))

    def spoiled(text):
        g = F.col("game_id")
        bad = F.when(g % 11 == 3, F.concat(text, F.unhex(F.lit("C328")).cast("string")))
        return bad.when(g % 13 == 4, F.concat(text, F.lit('\n"open'))).when(g % 17 == 5, F.concat(text, F.lit("\n1;2;3;4;5;6;7"))).otherwise(text)

    team_files = files(team, team_head, "-teams.csv").withColumn("value", spoiled(F.col("value")))
    both = team_files.unionByName(files(player, player_head, "-players.csv"))
    folder = F.when(F.col("game_id") % 3 == 0, "Group Stages/Group A").otherwise("Playoff 1")
    root = scratch_table(spark, "exports")
    named = both.filter(F.col("file").isNotNull())  # lines without a supplier are no game
    placed = named.select(F.concat_ws("/", folder, "file").alias("file"), F.concat("value", F.lit("\n")).cast("binary").alias("body"))
    # Files are many and small: a number of partitions that is given is not merged into fewer tasks.
    dealt = placed.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    x.write_files(dealt, root)
    return root


def read_files(spark, sf):
    """Lines of the written files; the files are listed once."""
    root = written_exports(spark, sf)
    files = x.export_listing(spark, root)
    found = x.read_exports(spark, root, files=files).unionByName(x.unreadable_exports(spark, root, files=files))
    below = F.concat(F.lit(ROOT + "/"), F.substring_index("path", root.rsplit("/", 1)[-1] + "/", -1))
    return tables.written(x.parse_exports(x.with_path_fields(found.withColumn("path", below), ROOT)), "export-lines")


@register(
    "read_exports_files",
    f"""with {LINES} select game_id || '' as replay_id, case when game_id % 3 = 0 then 'Group Stages/Group A' else 'Playoff 1' end as folder,
  color, player, count(*)::double as goals, sum(quantity)::double as assists from lines group by game_id, color, player""",
)
def read_exports_files(spark, sf):
    rows = x.player_stats(read_files(spark, sf).filter(F.col("kind") == "player"))
    return rows.select("replay_id", "folder", "color", "player", "goals", "assists")


@register(
    "quarantine_files",
    f"""with {LINES} select case when f.game_id % 3 = 0 then 'Group Stages/Group A' else 'Playoff 1' end as folder, f.game_id || '' as replay_id,
  case when fault is not null then fault when n <> 2 then 'team_rows_not_2' end as reject_reason
from faults f join (select game_id, count(*) as n from side group by 1) s using (game_id)""",
)
def quarantine_files(spark, sf):
    """Why a game's files can't be used, what reading found among it."""
    return x.reject_reasons(read_files(spark, sf), ["color", "team name", "score", "goals"])


@register(
    "game_rows_from_team_files",
    f"""with {LINES}, b as (select * from side where color = 'blue'), o as (select * from side where color = 'orange')
select game_id || '' as replay_id, b.team as blue_team, o.team as orange_team, b.score::double as blue_score, o.score::double as orange_score,
  b.goals::double as blue_goals, o.goals::double as orange_goals, case when game_id % 2 = 0 then '300' end as game_duration,
  case when b.score > o.score then b.team when o.score > b.score then o.team else '' end as game_winner
from b join o using (game_id) join faults using (game_id) where fault is null""",
)
def game_rows_from_team_files(spark, sf):
    """Games whose statistics are the team rows' own; the higher score wins."""
    out = x.game_rows(read_files(spark, sf), ["color", "team name", "score", "goals"], source="team")
    sides = [f"{c}_{f}" for f in ("team", "score", "goals") for c in COLOURS]
    return out.select("replay_id", *sides, "game_duration", "game_winner")


# --- order of files and rows ---------------------------------------------------------------

FILED = """
filed as (
  select game_id % 3 as file, row_number() over (partition by game_id % 3 order by game_id, color, line, player) as row, player, goals from players),
ranked as (select *, row_number() over (partition by player order by file, row) as k, count(*) over (partition by player) as n from filed)"""


def _filed(spark, sf):
    """Player statistics as rows of three files, under names that each file spells in its own way."""
    spelled = F.when(F.col("game_id") % 3 == 0, F.lower("player")).when(F.col("game_id") % 3 == 1, F.concat(F.lit(" "), F.col("player"))).otherwise(F.concat("player", F.lit(".")))
    rows = views.players(spark, sf).select((F.col("game_id") % 3).alias("file"), "game_id", "color", "line", "player", "goals")
    placed = with_position(rows, ["file"], ["game_id", "color", "line", "player"], "row")
    named = [F.col("row").cast("int").alias("row"), spelled.alias("player_name"), F.col("goals").cast("string").alias("career_games")]
    return tables.written(placed.select("file", *named), "filed")


@register(
    "player_history_first",
    f"with {PLAYERS}, {FILED} select lower(player) as key, goals::double as career_games, n as rows from ranked where k = 1",
)
def player_history_first(spark, sf):
    """The first row of each player by file and row, whatever the partitions; and how many there were."""
    rows = _filed(spark, sf)
    pieces = -(-rows.count() // PIECE_ROWS)
    parts = []
    for n in (3, 11):
        kept = tables.player_history(rows.repartition(n * max(1, -(-pieces // n))), sequence=["file", "row"], keep="first", key=canonical_key)
        parts.append(kept.select(canonical_key(F.col("player")).alias("key"), "career_games"))
    doubled = tables.history_duplicates(rows, key=canonical_key).select("key", "rows")
    return parts[0].join(parts[1], ["key", "career_games"]).join(doubled, "key", "left").withColumn("rows", F.coalesce("rows", F.lit(1).cast("long")))


# --- a stage that grows by runs ------------------------------------------------------------


@register(
    "resume_collection",
    """with r as (
  select o_custkey as replay_id, o_orderkey as fetched, cast(o_totalprice * 100 as bigint) as cents,
    row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders)
select replay_id, fetched, cents, 0::bigint as still_to_fetch from r where k = 1""",
)
def resume_collection(spark, sf):
    """Three batches into a keyed stage. The second run is ended before its commit and run again,
    a fourth fails its gate: neither leaves a trace."""
    rows = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("replay_id"), F.col("o_orderkey").alias("fetched"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )
    stage = stages.KeyedStage(spark, scratch_table(spark, "collection"), "replay_id", "fetched", buckets=4)
    batch = [rows.filter(F.pmod(F.xxhash64("replay_id"), F.lit(5)).isin(*hashes)) for hashes in ([0, 1], [1, 2, 3], [4])]
    priced = {"priced": F.col("cents") > 0, "named": F.col("replay_id").isNotNull()}
    stage.upsert(batch[0], priced)
    stage.write(batch[1])  # and no commit
    stage.upsert(batch[1], priced)
    stage.upsert(batch[2], priced)
    try:
        stage.upsert(rows.withColumn("cents", -F.col("cents")).withColumn("fetched", F.col("fetched") + 1), priced)
    except stages.GateError:
        left = stage.to_fetch(rows).agg(F.count(F.lit(1)).alias("still_to_fetch"))
        return stage.read().select("replay_id", "fetched", "cents").crossJoin(F.broadcast(left))  # one row
    raise AssertionError("the gate did not hold")
