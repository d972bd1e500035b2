"""Preprocessing and models on the whole modelling table, fold by fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.evaluation import metrics as m
from seriesmill.models import fit, store
from seriesmill.models.preprocess import fit_median_imputer, fit_standard_scaler
from seriesmill.operators import dataset as d
from seriesmill.operators import profile
from seriesmill.plans.catalog import r6, r6_sql, register
from seriesmill.plans.queries_dataset import PREDICTORS, TABLE_SQL, modelling_table
from seriesmill.plans.views import predictions
from seriesmill.plans.views_sql import PREDICTIONS
from seriesmill.session import shared_folder
from seriesmill.sources.tables import written

MEDIANS = f"""{TABLE_SQL}, med as (
  select {", ".join(f'median("{c}") as "{c}"' for c in PREDICTORS)} from modelling where tournament_order <= 1),
filled as (select m.contest_id, m.tournament_order, {", ".join(f'coalesce(m."{c}", med."{c}") as "{c}"' for c in PREDICTORS)}
  from modelling m, med)"""


def table(spark, sf):
    return written(modelling_table(spark, sf), "modelling")


@register(
    "median_imputer",
    f"""{MEDIANS} select contest_id, {", ".join(f'{r6_sql(chr(34) + c + chr(34))} as "{c}"' for c in PREDICTORS)} from filled""",
)
def median_imputer(spark, sf):
    """Medians of the first fold's training rows fill the holes of every row."""
    rows = table(spark, sf)
    imputer = fit_median_imputer(rows.filter(F.col("fold1_role") == "train"), PREDICTORS)
    return imputer.transform(rows).select("contest_id", *[r6(F.col(c)).alias(c) for c in PREDICTORS])


@register(
    "standard_scaler",
    f"""{MEDIANS}, mom as (select {", ".join(f'avg("{c}") as "m{i}", case when min("{c}") = max("{c}") then 1 else stddev_pop("{c}") end as "s{i}"'
      for i, c in enumerate(PREDICTORS))} from filled where tournament_order <= 1)
select contest_id, {", ".join(f'''{r6_sql(f'("{c}" - m{i}) / s{i}')} as "{c}"''' for i, c in enumerate(PREDICTORS))} from filled, mom""",
)
def standard_scaler(spark, sf):
    rows = table(spark, sf)
    train = F.col("fold1_role") == "train"
    filled = fit_median_imputer(rows.filter(train), PREDICTORS).transform(rows)
    scaler = fit_standard_scaler(filled.filter(train), PREDICTORS)
    return scaler.transform(filled).select("contest_id", *[r6(F.col(c)).alias(c) for c in PREDICTORS])


def _run(spark, sf, how):
    rows = d.missing_indicators(table(spark, sf), PREDICTORS)
    features = PREDICTORS + [c for c in rows.columns if c.endswith(d.MISSING_SUFFIX)]
    return fit.run_temporal_folds(rows, features, 2, _kept(spark, how), ["contest_id"], at_once=2 if how is fit.fit_mlp else 1)


def _kept(spark, how):
    """Folds are fitted by the first query that needs them."""
    return store.kept(how, f"{shared_folder(spark)}/fitted", how.__name__)


@register("logistic_folds")
def logistic_folds(spark, sf):
    return _run(spark, sf, fit.fit_logistic)[0]


@register("logistic_metrics")
def logistic_metrics(spark, sf):
    scored, _ = _run(spark, sf, fit.fit_logistic)
    return m.metrics_by_scope(scored.withColumn("model", F.lit("logistic_regression")))


@register("strongest_coefficients")
def strongest_coefficients(spark, sf):
    """The 12 largest coefficients of each fold."""
    _, fitted = _run(spark, sf, fit.fit_logistic)
    order = [F.desc("absolute_coefficient"), F.asc("feature")]
    return profile.top_per_group(fit.coefficient_table(spark, fitted), ["fold"], order, 12)


@register("forest_folds")
def forest_folds(spark, sf):
    return _run(spark, sf, fit.fit_forest)[0]


@register("forest_importances")
def forest_importances(spark, sf):
    _, fitted = _run(spark, sf, fit.fit_forest)
    return fit.importance_table(spark, fitted)


@register("mlp_folds")
def mlp_folds(spark, sf):
    return _run(spark, sf, fit.fit_mlp)[0]


@register("mlp_diagnostics")
def mlp_diagnostics(spark, sf):
    _, fitted = _run(spark, sf, fit.fit_mlp)
    return fit.training_diagnostics(spark, fitted)


# --- what SQL can say about the models ----------------------------------------------------

TESTED = f"""{TABLE_SQL}, tested as (
  select contest_id, 'fold_' || (tournament_order - 1) as fold, target from modelling where target is not null and tournament_order in (2, 3)),
trained as (
  select 'fold_' || k as fold, m.* from modelling m, (values (1), (2)) f(k) where target is not null and tournament_order <= k)"""
FOLD_ROWS = f"""{TESTED} select contest_id, fold, target, true as is_probability, true as class_follows, true as judged from tested"""


def _fold_rows(spark, sf, how):
    """The scored rows of each fold, and whether class and judgement follow from the score."""
    scored = _run(spark, sf, how)[0]
    p, c = F.col("probability"), F.col("prediction")
    return scored.select(
        "contest_id", "fold", "target", p.between(0, 1).alias("is_probability"), (c == (p >= 0.5).cast("int")).alias("class_follows"),
        (F.col("correct") == (c == F.col("target")).cast("int")).alias("judged"),
    )


@register("logistic_fold_rows", FOLD_ROWS)
def logistic_fold_rows(spark, sf):
    return _fold_rows(spark, sf, fit.fit_logistic)


@register("forest_fold_rows", FOLD_ROWS)
def forest_fold_rows(spark, sf):
    return _fold_rows(spark, sf, fit.fit_forest)


@register("mlp_fold_rows", FOLD_ROWS)
def mlp_fold_rows(spark, sf):
    return _fold_rows(spark, sf, fit.fit_mlp)


@register(
    "forest_importance_totals",
    f"""{TESTED}, used as (
  select fold, {" + ".join(f'(count("{c}") > 0)::int' for c in PREDICTORS)} as own from trained group by 1),
holes as (select {" + ".join(f'(count(*) > count("{c}"))::int' for c in PREDICTORS)} as indicators from modelling)
select fold, own + indicators as features, 1.0::double as total, true as none_negative from used, holes""",
)
def forest_importance_totals(spark, sf):
    """Importances of all inputs that have training values: none is negative, and they add up to 1."""
    out = forest_importances(spark, sf).groupBy("fold")
    return out.agg(F.count(F.lit(1)).cast("int").alias("features"), r6(F.sum("importance")).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


@register(
    "optimiser_progress",
    f"""{TESTED} select distinct m.model, fold, true as never_worse_at_the_end, case m.model when 'logistic' then {r6_sql("ln(2.0::double)")} end as first_loss
from trained cross join (values ('logistic'), ('mlp')) m(model)""",
)
def optimiser_progress(spark, sf):
    """Both optimisers end below where they began; without weights a logistic loss is ln 2."""
    parts = []
    for name, how in (("logistic", fit.fit_logistic), ("mlp", fit.fit_mlp)):
        steps = fit.training_diagnostics(spark, _run(spark, sf, how)[1])
        first, last = F.min_by("loss", "iteration"), F.max_by("loss", "iteration")
        known = first if name == "logistic" else F.lit(None).cast("double")
        parts.append(steps.groupBy("fold").agg((last <= first).alias("never_worse_at_the_end"), r6(known).alias("first_loss")).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


def newton_sql(steps: int) -> str:
    """CTEs ``w0`` to ``w<steps>``: Newton's steps of a penalised fit with a constant and two features."""
    parts = ["w0 as (select 0.0::double as a, 0.0::double as b, 0.0::double as c)"]
    for k in range(steps):
        parts.append(f"""g{k} as (
  select any_value(a) as a, any_value(b) as b, any_value(c) as c,
    any_value(a) + sum(p - y) as ga, any_value(b) + sum((p - y) * u) as gb, any_value(c) + sum((p - y) * v) as gc,
    1 + sum(p * (1 - p)) as haa, sum(p * (1 - p) * u) as hab, sum(p * (1 - p) * v) as hac,
    1 + sum(p * (1 - p) * u * u) as hbb, sum(p * (1 - p) * u * v) as hbc, 1 + sum(p * (1 - p) * v * v) as hcc
  from (select w.*, u, v, y, 1 / (1 + exp(-(a + b * u + c * v))) as p from scaled, w{k} w)),
d{k} as (
  select *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) as det from g{k}),
w{k + 1} as (
  select a - (ga * (hbb * hcc - hbc * hbc) + gb * (hac * hbc - hab * hcc) + gc * (hab * hbc - hac * hbb)) / det as a,
    b - (ga * (hbc * hac - hab * hcc) + gb * (haa * hcc - hac * hac) + gc * (hab * hac - haa * hbc)) / det as b,
    c - (ga * (hab * hbc - hbb * hac) + gb * (hab * hac - haa * hbc) + gc * (haa * hbb - hab * hab)) / det as c from d{k})""")
    return ", ".join(parts)


def _r4_sql(x):
    return f"floor(({x}) * 1e4 + 0.5::double) / 1e4"


@register(
    "logistic_two_features",
    f"""with {PREDICTIONS}, raw as (
  select id, any_value(target)::double as y, max(probability) filter (model = 'score_share') as u, max(probability) filter (model = 'size_share') as v
  from predictions where fold = 'fold_1' group by id),
filled as (select y, coalesce(u, median(u) over ()) as u, coalesce(v, median(v) over ()) as v from raw),
scaled as (select y, (u - avg(u) over ()) / stddev_pop(u) over () as u, (v - avg(v) over ()) / stddev_pop(v) over () as v from filled),
{newton_sql(9)}
select 'fold_1' as fold, 'score_share' as feature, {_r4_sql('b')} as coefficient from w9
union all select 'fold_1', 'size_share', {_r4_sql('c')} from w9""",
)
def logistic_two_features(spark, sf):
    """The fitted weights of two features, next to those of Newton's method in SQL."""
    names = ["score_share", "size_share"]
    cells = [F.max(F.when(F.col("model") == n, F.col("probability"))).alias(n) for n in names]
    rows = predictions(spark, sf).groupBy("id", "fold").agg(F.max("target").alias("target"), *cells)
    role = F.when(F.col("fold") == "fold_1", "train").otherwise("test")
    ready = written(rows.withColumn("fold1_role", role), "two-features")
    fitted = fit.run_temporal_folds(ready, names, 1, _kept(spark, fit.fit_logistic), ["id"])[1]
    out = fit.coefficient_table(spark, fitted)
    return out.select("fold", "feature", (F.floor(F.col("coefficient") * 1e4 + 0.5) / 1e4).alias("coefficient"))
