"""The modelling table and its profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.rules import is_playoff
from seriesmill.operators import attach, checks, history, profile
from seriesmill.operators import dataset as d
from seriesmill.operators.identity import resolve_identity
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register, stamp, stamp_sql
from seriesmill.plans.queries_reconcile import ROSTER_SQL, ROSTER_STATS, _history
from seriesmill.plans.views_sql import CONTESTS, GAMES, IDENTITY, PLAYERS, history_sql
from seriesmill.sources.tables import written


def modelling_table(spark, sf):
    """Contests -> identities -> roster and form features -> predictors and fold roles.

    Names and rosters are looked up in the written contests; the form features write what comes of it.
    """
    known = resolve_identity(written(views.contests(spark, sf), "contests"))
    rosters = attach.roster_history_features(known, _history(spark, sf), ROSTER_STATS)
    keep = ["contest_id", "ts", "tournament", "tournament_order", "target"]
    return d.assign_expanding_folds(d.select_features(history.form_features(rosters), keep), "tournament_order", 2)


TABLE_SQL = f"""{ROSTER_SQL}, {IDENTITY}, {history_sql('resolved')},
modelling as (
  select c.contest_id, c.tournament, c.tournament_order, c.target,
    {", ".join(f'a."{s}_mean" - b."{s}_mean" as "diff_{s}"' for s in ROSTER_STATS)},
    a.players_with_stats::double as team_a_players_with_stats, b.players_with_stats::double as team_b_players_with_stats,
    a.players_with_stats / a.players_total as team_a_coverage, b.players_with_stats / b.players_total as team_b_coverage,
    {", ".join(f'ha.{c}::double - hb.{c}::double as diff_{c}' for c in history.diff_columns())},
    ha.prior_series_played::double as team_a_prior_series_played, hb.prior_series_played::double as team_b_prior_series_played,
    ha.recent3_series_played::double as team_a_recent3_series_played, hb.recent3_series_played::double as team_b_recent3_series_played,
    ha.recent5_series_played::double as team_a_recent5_series_played, hb.recent5_series_played::double as team_b_recent5_series_played,
    case when c.stage = 'Playoff 1' then 1.0::double else 0.0::double end as is_playoff
  from resolved c join hist ha on ha.team = c.team_a and ha.ts = c.ts join hist hb on hb.team = c.team_b and hb.ts = c.ts
    join rh a on a.roster = c.team_a_players join rh b on b.roster = c.team_b_players)"""

PREDICTORS = (
    [f"diff_{s}" for s in ("2024_rating", "career_games", "career_rating")]
    + d.COVERAGE_FEATURES
    + d.FORM_DIFF_FEATURES
    + d.FORM_COVERAGE_FEATURES
    + d.STAGE_FEATURES
)
ROLES = """case when tournament_order <= 1 then 'train' when tournament_order = 2 then 'test' else 'unused' end as fold1_role,
  case when tournament_order <= 2 then 'train' when tournament_order = 3 then 'test' else 'unused' end as fold2_role"""


@register(
    "modelling_table",
    f"""{TABLE_SQL}
select contest_id, target, {", ".join(f'{r6_sql(chr(34) + c + chr(34))} as "{c}"' for c in PREDICTORS)}, {ROLES} from modelling""",
)
def modelling(spark, sf):
    out = modelling_table(spark, sf)
    return out.select(
        "contest_id", "target", *[r6(F.col(c)).alias(c) for c in PREDICTORS], "fold1_role", "fold2_role"
    )


@register(
    "missing_indicators",
    f"""{TABLE_SQL}, flags as materialized (
  select contest_id, {", ".join(f'("{c}" is null)::int as "{c}__missing"' for c in PREDICTORS)} from modelling),
long as materialized (select contest_id, feature, missing from (unpivot flags on columns(* exclude (contest_id)) into name feature value missing))
select * from long where feature in (select feature from long group by 1 having max(missing) = 1)""",
)
def missing_indicators(spark, sf):
    """The indicator columns as rows: which there are depends on the data."""
    table = written(modelling_table(spark, sf), "modelling")
    out = d.missing_indicators(table, PREDICTORS)
    names = [c for c in out.columns if c.endswith(d.MISSING_SUFFIX)]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("missing")) for c in names])
    return out.select("contest_id", F.explode(cells).alias("c")).select("contest_id", "c.*")


@register(
    "missingness_profile",
    f"""{TABLE_SQL}, p as (select count(*) as n, {", ".join(
        f'count("{c}") as "c{i}", count(distinct {r6_sql(chr(34) + c + chr(34))}) as "u{i}"' for i, c in enumerate(PREDICTORS))} from modelling)
{" union all ".join(f'''select '{c}' as feature, n - c{i} as missing_count, {r6_sql(f"100.0::double * (n - c{i}) / n")} as missing_pct,
  u{i} as unique_non_missing, u{i} <= 1 as constant_non_missing from p'''
    for i, c in enumerate(PREDICTORS))}""",
)
def missingness_profile(spark, sf):
    """Of values at six decimals: rates may differ in the last bit between engines."""
    table = modelling_table(spark, sf).select(*[r6(F.col(f"`{c}`").cast("double")).alias(c) for c in PREDICTORS])
    return profile.missingness_profile(table, PREDICTORS).withColumn("missing_pct", r6("missing_pct"))


@register("assign_expanding_folds", f"with {CONTESTS} select contest_id, {ROLES} from contests")
def folds(spark, sf):
    out = d.assign_expanding_folds(views.contests(spark, sf), "tournament_order", 2)
    return out.select("contest_id", "fold1_role", "fold2_role")


@register(
    "fold_role_counts",
    f"""with {CONTESTS}, r as (select tournament, {ROLES} from contests)
select tournament, fold1_role, fold2_role, count(*) as rows from r group by 1, 2, 3""",
)
def fold_role_counts(spark, sf):
    out = d.assign_expanding_folds(views.contests(spark, sf), "tournament_order", 2)
    return profile.value_counts(out, ["tournament", "fold1_role", "fold2_role"])


@register(
    "feature_groups",
    f"""{TABLE_SQL}, holes as (
  select {" + ".join(f'(count(*) > count("{c}"))::bigint' for c in PREDICTORS)} as n from modelling)
select * from (values ('history_difference', 3::bigint), ('history_coverage', 4::bigint), ('form_difference', 8::bigint),
  ('form_coverage', 6::bigint), ('prematch_stage', 1::bigint)) v(feature_group, features)
union all select 'missingness_indicator', n from holes""",
)
def feature_groups(spark, sf):
    """Families of the final inputs; which indicators there are depends on the data."""
    out = d.missing_indicators(written(modelling_table(spark, sf), "modelling"), PREDICTORS)
    inputs = PREDICTORS + [c for c in out.columns if c.endswith(d.MISSING_SUFFIX)]
    return d.feature_group_counts(d.feature_report(spark, inputs))


@register(
    "union_with_missing",
    """select o_orderkey as id, o_totalprice as price, null::bigint as parts, 'orders' as source from orders
union all select l_orderkey, null, count(*), 'lines' from lineitem group by l_orderkey""",
)
def union_with_missing(spark, sf):
    orders = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit("orders").alias("source")
    )
    lines = (
        views.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.count(F.lit(1)).alias("parts"))
        .withColumn("source", F.lit("lines"))
    )
    return d.union_all([orders, lines])


@register(
    "union_same_columns",
    f"""with {GAMES} select tournament, count(*) as games from (
  select tournament from games where stage = 'Playoff 1' union all select tournament from games where stage <> 'Playoff 1') group by 1""",
)
def union_same_columns(spark, sf):
    games = views.games(spark, sf)
    parts = [games.filter(F.col("stage") == "Playoff 1"), games.filter(F.col("stage") != "Playoff 1")]
    return d.union_all(parts).groupBy("tournament").agg(F.count(F.lit(1)).alias("games"))


@register("distinct_rows", "select distinct user_id, event_type from events")
def distinct_rows(spark, sf):
    return views.table(spark, sf, "events").select("user_id", "event_type").distinct()


@register(
    "id_intersection",
    "select l_orderkey as id from lineitem intersect select o_orderkey from orders where o_totalprice > 100000",
)
def id_intersection(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    dear = views.table(spark, sf, "orders").filter(F.col("o_totalprice") > 100000)
    return lines.intersect(dear.select(F.col("o_orderkey").alias("id")))


@register("id_difference", "select o_orderkey as id from orders except select l_orderkey from lineitem")
def id_difference(spark, sf):
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.subtract(views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@register(
    "group_sizes",
    f"with {GAMES} select stage, subgroup, count(*) as rows from games group by 1, 2",
)
def group_sizes(spark, sf):
    return profile.value_counts(views.games(spark, sf), ["stage", "subgroup"])


@register(
    "value_counts",
    f"with {GAMES} select blue_team, count(*) as rows from games group by 1",
)
def value_counts(spark, sf):
    return profile.value_counts(views.games(spark, sf), ["blue_team"])


@register(
    "mode_name",
    f"""with {PLAYERS}, c as (select game_id, player, count(*) as n from players group by 1, 2)
select game_id, arg_min(player, (-n, player)) as most_frequent from c group by 1""",
)
def mode_name(spark, sf):
    from seriesmill.operators.series import mode_name as mode

    return mode(views.players(spark, sf), ["game_id"], "player", "most_frequent")


@register(
    "crosstab",
    f"""with {CONTESTS} select tournament, count(*) filter (target = 0) as target_0, count(*) filter (target = 1) as target_1,
  count(*) filter (target is null) as missing from contests group by 1""",
)
def crosstab(spark, sf):
    return profile.crosstab(views.contests(spark, sf), "tournament", "target", [0, 1])


@register(
    "coverage",
    f"""with {CONTESTS} select tournament, count(*) as rows, {stamp_sql('min(ts)')} as first_time, {stamp_sql('max(ts)')} as last_time,
  count(*) filter (team_a is null or team_b is null) as unnamed, count(*) filter (target is null) as undecided
from contests group by 1""",
)
def coverage(spark, sf):
    flags = {
        "unnamed": F.col("team_a").isNull() | F.col("team_b").isNull(),
        "undecided": F.col("target").isNull(),
    }
    out = profile.coverage(views.contests(spark, sf), "tournament", "ts", flags)
    return out.withColumns({c: stamp(c) for c in ("first_time", "last_time")})


@register(
    "history_coverage_summary",
    f"""{ROSTER_SQL}
select count(*) filter (a.players_matched < a.players_total or b.players_matched < b.players_total) as name_unmatched,
  count(*) filter (a.career_rating_mean is null or b.career_rating_mean is null) as all_differences_missing, count(*) as rows
from contests join rh a on a.roster = team_a_players join rh b on b.roster = team_b_players""",
)
def history_coverage_summary(spark, sf):
    out = attach.roster_history_features(views.contests(spark, sf), _history(spark, sf), ROSTER_STATS)
    unmatched = (F.col("team_a_players_matched") < F.col("team_a_players_total")) | (
        F.col("team_b_players_matched") < F.col("team_b_players_total")
    )
    return out.agg(
        F.count_if(unmatched).alias("name_unmatched"),
        F.count_if(d.all_missing([f"diff_{s}" for s in ROSTER_STATS])).alias("all_differences_missing"),
        F.count(F.lit(1)).alias("rows"),
    )


@register(
    "timestamp_collisions",
    f"with {GAMES} select tournament, {stamp_sql('ts')} as ts, count(*) as rows from games group by tournament, games.ts having count(*) > 1",
)
def timestamp_collisions(spark, sf):
    out = profile.timestamp_collisions(views.games(spark, sf), ["tournament", "ts"])
    return out.withColumn("ts", stamp("ts"))


@register(
    "collision_summary",
    f"""with {GAMES}, t as (select ts, count(*) as n from games group by 1)
select cast(sum(n) as bigint) as rows, count(*) as unique_times, count(*) filter (n > 1) as shared_times,
  cast(sum(n) filter (n > 1) as bigint) as rows_on_shared_times from t""",
)
def collision_summary(spark, sf):
    return profile.collision_summary(views.games(spark, sf), "ts")


@register(
    "expand_collisions",
    f"""with {GAMES}, t as (select game_id, count(*) over (partition by ts) as rows from games)
select * from t where rows > 1""",
)
def expand_collisions(spark, sf):
    out = profile.expand_collisions(views.games(spark, sf).select("game_id", "ts"), ["ts"])
    return out.select("game_id", "rows")


@register(
    "duplicated_keys",
    "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1",
)
def duplicated_keys(spark, sf):
    return checks.duplicated_keys(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "duplicate_counts",
    """with k as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
select cast(sum(n) as bigint) as rows, count(*) as distinct_keys, cast(sum(n - 1) as bigint) as duplicates from k""",
)
def duplicate_counts(spark, sf):
    return profile.duplicate_counts(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "expect",
    f"""with {CONTESTS}, c as (
  select count(*) as n, count(*) filter (ts is null) as no_ts, count(*) filter (target not in (0, 1)) as bad_target,
    count(*) filter (team_a is null) as no_team from contests)
select 'missing_ts' as "check", no_ts as found, 0::bigint as expected, 'PASS' as status from c
union all select 'invalid_target', bad_target, 0, 'PASS' from c
union all select 'missing_team_a', no_team, 0, case when no_team = 0 then 'PASS' else 'CHECK' end from c""",
)
def expect(spark, sf):
    return checks.expect(
        views.contests(spark, sf),
        {
            "missing_ts": (F.count_if(F.col("ts").isNull()), 0),
            "invalid_target": (F.count_if(~F.col("target").isin(0, 1)), 0),
            "missing_team_a": (F.count_if(F.col("team_a").isNull()), 0),
        },
    )


@register(
    "coalesce_columns",
    f"""with {GAMES} select game_id, {r6_sql('case when blue_size > 2 then blue_score else orange_score end')} as coverage from games""",
)
def coalesce_columns(spark, sf):
    games = views.games(spark, sf).withColumn("fraction", F.when(F.col("blue_size") > 2, F.col("blue_score")))
    out = d.coalesce_columns(games, "coverage", ["fraction", "absent", "orange_score"])
    return out.select("game_id", r6("coverage").alias("coverage"))


@register(
    "is_playoff",
    f"with {GAMES} select stage, case when stage = 'Playoff 1' then 1 else 0 end as is_playoff, count(*) as rows from games group by 1",
)
def playoff_flag(spark, sf):
    flagged = views.games(spark, sf).withColumn("is_playoff", is_playoff(F.col("stage")))
    return profile.value_counts(flagged, ["stage", "is_playoff"])


@register(
    "top_per_group",
    f"""with {GAMES}
select * from (select stage, game_id, row_number() over (partition by stage order by blue_score desc, game_id) as rank from games)
where rank <= 12""",
)
def top_per_group(spark, sf):
    """The 12 highest blue scores of each stage."""
    order = [F.desc("blue_score"), F.asc("game_id")]
    return profile.top_per_group(views.games(spark, sf), ["stage"], order, 12).select("stage", "game_id", "rank")


@register(
    "head",
    f"with {GAMES} select game_id, subgroup from games order by subgroup desc nulls last, blue_score desc, game_id limit 20",
)
def head(spark, sf):
    order = [F.col("subgroup").desc_nulls_last(), F.desc("blue_score"), F.asc("game_id")]
    return profile.head(views.games(spark, sf), order, 20).select("game_id", "subgroup")


@register(
    "multi_key_sort",
    f"with {GAMES} select tournament, subgroup, game_id from games order by tournament, subgroup nulls last, game_id desc",
)
def multi_key_sort(spark, sf):
    return (
        views.games(spark, sf)
        .select("tournament", "subgroup", "game_id")
        .orderBy("tournament", F.col("subgroup").asc_nulls_last(), F.desc("game_id"))
    )


@register(
    "rename_select_drop",
    """select o_orderkey as replay_id, o_totalprice as price from orders""",
)
def rename_select_drop(spark, sf):
    orders = views.table(spark, sf, "orders")
    renamed = orders.withColumnsRenamed({"o_orderkey": "replay_id", "o_totalprice": "price"})
    results = checks.leakage_columns(renamed.columns, ("status", "priority", "date", "custkey"))
    return renamed.drop(*results)


@register(
    "filters",
    f"""with {GAMES} select game_id from games where stage in ('Playoff 1', 'Final') and tournament not in ('Open 2')
  and blue_team is not null and (subgroup is null or subgroup = 'Group A') and blue_goals between 1 and 4 and not (orange_goals > 4)""",
)
def filters(spark, sf):
    g = F.col
    return (
        views.games(spark, sf)
        .filter(g("stage").isin("Playoff 1", "Final") & ~g("tournament").isin("Open 2"))
        .filter(g("blue_team").isNotNull() & (g("subgroup").isNull() | (g("subgroup") == "Group A")))
        .filter(g("blue_goals").between(1, 4) & ~(g("orange_goals") > 4))
        .select("game_id")
    )


@register(
    "diff_features",
    f"""with {CONTESTS} select contest_id, a_games::double - b_games::double as diff_games from contests""",
)
def diff_features(spark, sf):
    contests = views.contests(spark, sf).withColumnsRenamed({"a_games": "team_a_games", "b_games": "team_b_games"})
    return history.diff_features(contests, ["games"]).select("contest_id", "diff_games")


COMPARED = {"orders": "orders", "lines": "lineitem", "customers": "customer"}


@register(
    "column_alignment",
    """with c as (
  select lower(column_name) as column_name, table_name from duckdb_columns() where table_name in ('orders', 'lineitem', 'customer'))
select column_name, bool_or(table_name = 'orders') as orders, bool_or(table_name = 'lineitem') as lines, bool_or(table_name = 'customer') as customers,
  count(*) = 3 as shared from (select distinct substr(column_name, instr(column_name, '_') + 1) as column_name, table_name from c) group by 1""",
)
def column_alignment(spark, sf):
    """Which columns three tables share, by their names without the table's letter."""
    frames = {}
    for name, source in COMPARED.items():
        df = views.table(spark, sf, source)
        frames[name] = df.toDF(*[c.split("_", 1)[1] for c in df.columns])
    return checks.column_alignment(spark, frames)


@register(
    "require_columns",
    """select 'orders' as source, count(*) as rows, null as fault from orders
union all select 'lineitem', null, 'missing columns: l_totalprice, l_weather'
union all select 'customer', null, 'missing columns: c_weather'""",
)
def require_columns(spark, sf):
    """Rows of the tables that have what is asked of them, and what the others lack."""
    wanted = {"orders": ["o_orderkey", "o_totalprice"], "lineitem": ["l_totalprice", "l_orderkey", "l_weather"], "customer": ["c_custkey", "c_weather"]}
    parts = []
    for source, names in wanted.items():
        df = views.table(spark, sf, source)
        try:
            part = checks.require_columns(df, names).agg(F.count(F.lit(1)).alias("rows")).withColumn("fault", F.lit(None).cast("string"))
        except ValueError as e:
            part = spark.createDataFrame([(None, str(e))], "rows long, fault string")
        parts.append(part.select(F.lit(source).alias("source"), "rows", "fault"))
    return parts[0].union(parts[1]).union(parts[2])
