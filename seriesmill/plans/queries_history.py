"""Form before each contest (the flagship), its parts and its audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import history as h
from seriesmill.operators.identity import resolve_identity
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register, stamp, stamp_sql
from seriesmill.plans.views_sql import CONTESTS, IDENTITY, history_sql
from seriesmill.sources.tables import written

BASE = f"with {CONTESTS}, {IDENTITY}, {history_sql('resolved')}"
RATES = ("win_rate",)


def _known(spark, sf):
    """Contests with identities, as a table: every branch of a history reads them."""
    return written(resolve_identity(views.contests(spark, sf)), "contests")


def _is_rate(name: str) -> bool:
    return name.endswith("win_rate")


def _out(df, columns):
    return df.select(
        "contest_id", *[(r6(c) if _is_rate(c) else F.col(c).cast("long")).alias(c) for c in columns]
    )


def _side_sql(columns, sides=("a", "b")):
    return ", ".join(
        f"{r6_sql(f'h{s}.{c}') if _is_rate(c) else f'h{s}.{c}'} as team_{s}_{c}" for s in sides for c in columns
    )


JOINED = """from resolved c
  join hist ha on ha.team = c.team_a and ha.ts = c.ts
  join hist hb on hb.team = c.team_b and hb.ts = c.ts"""


def _diff_sql(columns):
    return ", ".join(
        f"{r6_sql(f'ha.{c}::double - hb.{c}::double')} as diff_{c}" for c in columns
    )


@register(
    "form_features",
    f"""{BASE}
select c.contest_id, {_side_sql(h.form_columns())}, {_diff_sql(h.diff_columns())}
{JOINED}""",
)
def form_features(spark, sf):
    out = h.form_features(_known(spark, sf))
    sides = [f"team_{s}_{c}" for s in ("a", "b") for c in h.form_columns()]
    diffs = [r6(f"diff_{c}").alias(f"diff_{c}") for c in h.diff_columns()]
    return out.select(
        "contest_id", *[(r6(c) if _is_rate(c) else F.col(c).cast("long")).alias(c) for c in sides], *diffs
    )


@register(
    "prior_history",
    f"""{BASE} select c.contest_id, {_side_sql(h.form_columns(())[:-1])} {JOINED}""",
)
def prior_history(spark, sf):
    columns = [f"team_{s}_{c}" for s in ("a", "b") for c in h.form_columns(())[:-1]]
    return _out(h.prior_history(_known(spark, sf)), columns)


def _recent(k):
    columns = h.form_columns((k,))[-3:]
    sql = f"""with {CONTESTS}, {IDENTITY}, {history_sql('resolved', (k,))}
select c.contest_id, {_side_sql(columns)} {JOINED}"""

    @register(f"recent_{k}", sql)
    def recent(spark, sf):
        return _out(
            h.recent_k(_known(spark, sf), k), [f"team_{s}_{c}" for s in ("a", "b") for c in columns]
        )


_recent(3)
_recent(5)


@register(
    "win_streak", f"""{BASE} select c.contest_id, {_side_sql(['prior_series_win_streak'])} {JOINED}"""
)
def win_streak(spark, sf):
    return _out(
        h.win_streak(_known(spark, sf)),
        ["team_a_prior_series_win_streak", "team_b_prior_series_win_streak"],
    )


@register(
    "form_coverage",
    f"""{BASE}
select c.tournament, count(*) as rows, count(*) filter (ha.prior_series_played = 0) as team_a_zero_history,
  count(*) filter (hb.prior_series_played = 0) as team_b_zero_history,
  {r6_sql('avg(ha.prior_series_played)')} as mean_team_a_prior_series,
  {r6_sql('avg(hb.prior_series_played)')} as mean_team_b_prior_series
{JOINED} group by 1""",
)
def form_coverage(spark, sf):
    out = h.form_coverage(h.prior_history(_known(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("mean_team_a_prior_series", "mean_team_b_prior_series")})


# The audits look for a leak. To have rows to find, they are pointed at counts that leak
# on purpose: a running number per team, which sees contests of the same moment.
LEAKY_SQL = """
leaky as (
  select *, row_number() over (partition by team order by ts, tournament_order, contest_id, side) - 1
            + case when team like 'P1%' then 1 else 0 end as value from parts)"""


def _leaky(spark, sf):
    from seriesmill.operators.ordering import with_position

    sides = h.sides_of(_known(spark, sf).withColumns({f"team_{s}_x": F.lit(0) for s in ("a", "b")}), "x")
    numbered = with_position(
        sides,
        ["team"],
        ["ts", "tournament_order", "contest_id", "side"],
        "n",
        start=0,
    )
    value = F.col("n") + F.when(F.col("team").startswith("P1"), 1).otherwise(0)
    both = numbered.groupBy("contest_id", "ts", "tournament_order").agg(
        *[
            F.max(F.when(F.col("side") == s, c)).alias(name)
            for s, side in (("A", "a"), ("B", "b"))
            for c, name in ((F.col("team"), f"team_{side}"), (value, f"team_{side}_prior_series_played"))
        ]
    )
    return both


@register(
    "first_appearance_audit",
    f"""{BASE}, {LEAKY_SQL}
select team, contest_id, value as first_value from (
  select *, row_number() over (partition by team order by ts, tournament_order, contest_id, side) as k from leaky)
where k = 1 and value <> 0""",
)
def first_appearance_audit(spark, sf):
    return h.first_appearance_audit(_leaky(spark, sf))


@register(
    "same_time_audit",
    f"""{BASE}, {LEAKY_SQL}
select {stamp_sql('ts')} as ts, team, min(value) as lowest, max(value) as highest from leaky
group by ts, team having min(value) <> max(value)""",
)
def same_time_audit(spark, sf):
    return h.same_time_audit(_leaky(spark, sf)).withColumn("ts", stamp("ts"))


@register(
    "leak_free_audits",
    f"""{BASE}, played as (
  select p.*, (select count(*) from parts q where q.team = p.team and q.ts < p.ts and q.won is not null) as value from parts p),
first as (select *, row_number() over (partition by team order by ts, tournament_order, contest_id, side) as k from played),
same as (select ts, team from played group by 1, 2 having min(value) <> max(value))
select (select count(*) from first where k = 1 and value <> 0) as first_appearance_violations,
  (select count(*) from same) as same_time_violations, (select count(*) from contests) as contests""",
)
def leak_free_audits(spark, sf):
    """Both audits on the library's own features: no violation among all contests."""
    features = h.prior_history(_known(spark, sf))
    first = h.first_appearance_audit(features).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("first"))
    same = h.same_time_audit(features).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("same"))
    rows = features.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("rows"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    return (
        first.unionByName(same)
        .unionByName(rows)
        .agg(
            pick("first").alias("first_appearance_violations"),
            pick("same").alias("same_time_violations"),
            pick("rows").alias("contests"),
        )
    )
