"""Scoring and comparing three models on the decided games of the test periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.evaluation import bootstrap as b
from seriesmill.evaluation import metrics as m
from seriesmill.operators import checks
from seriesmill.operators import dataset as d
from seriesmill.plans import views
from seriesmill.plans.catalog import r6, r6_sql, register
from seriesmill.plans.views_sql import CONTESTS, PREDICTIONS
from seriesmill.sources.tables import written

MODELS = ["score_share", "scramble", "size_share"]
REPS = 10_000
LISTED_REPS = 1000
SEED = 42

SCORED = f"""with {PREDICTIONS}, preds as (
  select *, (probability >= 0.5)::int as prediction, ((probability >= 0.5)::int = target)::int as correct from predictions)"""
EPS = "2.220446049250313e-16"
LOSS = f"-ln(case when target = 1 then greatest(least(probability, 1 - {EPS}), {EPS}) else 1 - greatest(least(probability, 1 - {EPS}), {EPS}) end)"


def preds(spark, sf):
    return m.with_decisions(views.predictions(spark, sf))


def metric_sql(source: str, keys: str, weight: str = "1") -> str:
    """CTEs ending in ``metrics`` with all metrics per key."""
    by = f"partition by {keys}" if keys else ""
    group = f"group by {keys}" if keys else ""
    w = weight
    return f"""
sums as (
  select {keys}, sum({w}) filter (target = 0 and prediction = 0) as tn0, sum({w}) filter (target = 0 and prediction = 1) as fp0,
    sum({w}) filter (target = 1 and prediction = 0) as fn0, sum({w}) filter (target = 1 and prediction = 1) as tp0,
    sum({w} * ({LOSS})) / sum({w}) as log_loss, sum({w} * (probability - target) * (probability - target)) / sum({w}) as brier_score
  from {source} {group}),
scores as (
  select {keys}, probability, sum(case when target = 1 then {w} else 0 end) as pos, sum(case when target = 0 then {w} else 0 end) as neg
  from {source} group by {keys}, probability),
ranked as (
  select *, coalesce(sum(neg) over ({by} order by probability rows between unbounded preceding and 1 preceding), 0) as lower from scores),
areas as (
  select {keys}, case when sum(pos) > 0 and sum(neg) > 0 then
    sum(pos::double * (lower + neg / 2)) / (sum(pos)::double * sum(neg)) end as roc_auc from ranked {group}),
counts as (
  select *, coalesce(tn0, 0)::bigint as tn, coalesce(fp0, 0)::bigint as fp, coalesce(fn0, 0)::bigint as fn, coalesce(tp0, 0)::bigint as tp from sums),
metrics as (
  select *, tn + fp + fn + tp as n, (tp + fn) / (tn + fp + fn + tp) as positive_rate,
    (tp + fp) / (tn + fp + fn + tp) as predicted_positive_rate, (tn + tp) / (tn + fp + fn + tp) as accuracy,
    case when tp + fp = 0 then 0.0::double else tp / (tp + fp) end as precision,
    case when tp + fn = 0 then 0.0::double else tp / (tp + fn) end as recall,
    case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end as f1
  from counts join areas using ({keys}))"""


RATES = ["positive_rate", "predicted_positive_rate", "accuracy", "precision", "recall", "f1"]
LOSSES = ["log_loss", "brier_score", "roc_auc"]


def _rounded_sql(columns):
    return ", ".join(f"{r6_sql(c)} as {c}" for c in columns)


def _rounded(df, columns):
    return df.withColumns({c: r6(c) for c in columns})


BY_FOLD = metric_sql("preds", "model, fold")


@register(
    "decide",
    f"{SCORED} select id, model, prediction, correct from preds",
)
def decide(spark, sf):
    return preds(spark, sf).select("id", "model", "prediction", "correct")


@register("confusion", f"{SCORED}, {BY_FOLD} select model, fold, tn, fp, fn, tp from metrics")
def confusion(spark, sf):
    return m.confusion(preds(spark, sf), ["model", "fold"])


@register(
    "classification_metrics",
    f"{SCORED}, {BY_FOLD} select model, fold, tn, fp, fn, tp, n, {_rounded_sql(RATES)} from metrics",
)
def classification_metrics(spark, sf):
    return _rounded(m.with_rates(m.confusion(preds(spark, sf), ["model", "fold"])), RATES)


@register(
    "probability_losses",
    f"{SCORED}, {BY_FOLD} select model, fold, {_rounded_sql(['log_loss', 'brier_score'])} from metrics",
)
def probability_losses(spark, sf):
    return _rounded(m.probability_losses(preds(spark, sf), ["model", "fold"]), ["log_loss", "brier_score"])


@register("roc_auc", f"{SCORED}, {BY_FOLD} select model, fold, {_rounded_sql(['roc_auc'])} from metrics")
def roc_auc(spark, sf):
    return _rounded(m.roc_auc(preds(spark, sf), ["model", "fold"]), ["roc_auc"])


@register(
    "metrics_by_scope",
    f"""{SCORED}, scoped as (select * from preds union all select * replace ('pooled' as fold) from preds),
{metric_sql('scoped', 'model, fold')}
select model, fold, tn, fp, fn, tp, n, {_rounded_sql(RATES + LOSSES)} from metrics""",
)
def metrics_by_scope(spark, sf):
    return _rounded(m.metrics_by_scope(preds(spark, sf)), RATES + LOSSES)


@register(
    "roc_points",
    f"""{SCORED}, s as (
  select model, probability, sum(target) as pos, count(*) - sum(target) as neg from preds group by 1, 2),
t as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n
  from s window w as (partition by model order by probability desc))
select model, {r6_sql('probability')} as threshold, {r6_sql('fp / n')} as fpr, {r6_sql('tp / p')} as tpr from t
union all select distinct model, null, 0.0::double, 0.0::double from s""",
)
def roc_points(spark, sf):
    return _rounded(m.roc_points(preds(spark, sf), ["model"]), ["threshold", "fpr", "tpr"])


@register(
    "calibration",
    f"""{SCORED}, e as (
  select model, quantile_cont(probability, [0.2, 0.4, 0.6, 0.8]) as edges from preds group by 1),
binned as (select p.*, len(list_filter(edges, lambda x: x < probability))::int as slot from preds p join e using (model))
select model, cast(row_number() over (partition by model order by slot) as integer) as bin, count(*) as n,
  {r6_sql('avg(probability)')} as mean_predicted_probability, {r6_sql('avg(target)')} as observed_rate
from binned group by model, slot""",
)
def calibration(spark, sf):
    return _rounded(m.calibration(preds(spark, sf), ["model"]), ["mean_predicted_probability", "observed_rate"])


WIDE = f"""{SCORED}, wide as (
  select id, fold, target, {", ".join(f"max({c}) filter (model = '{x}') as {x}_{c}" for x in MODELS for c in ("probability", "prediction", "correct"))},
    cast(sum(correct) as int) as models_correct, cast(3 - sum(correct) as int) as models_wrong from preds group by 1, 2, 3)"""


def _wide(spark, sf):
    return m.compare_models_wide(preds(spark, sf), MODELS)


@register(
    "compare_models_wide",
    f"""{WIDE} select * replace ({", ".join(f"{r6_sql(f'{x}_probability')} as {x}_probability" for x in MODELS)}) from wide""",
)
def compare_models_wide(spark, sf):
    return _rounded(_wide(spark, sf), [f"{x}_probability" for x in MODELS])


@register(
    "error_overlap",
    f"""{WIDE} select models_wrong, count(*) as contests, {r6_sql('100.0::double * count(*) / sum(count(*)) over ()')} as percentage from wide group by 1""",
)
def error_overlap(spark, sf):
    return _rounded(m.error_overlap(_wide(spark, sf)), ["percentage"])


@register("missed_by_all", f"{WIDE} select id, fold, target from wide where models_wrong = 3")
def missed_by_all(spark, sf):
    return m.missed_by_all(_wide(spark, sf), MODELS).select("id", "fold", "target")


@register(
    "rank_models",
    f"""{SCORED}, {metric_sql('preds', 'model')}
{" union all ".join(f"select model, '{c}' as metric, rank() over (order by {c} {'desc' if up else 'asc'})::int as rank from metrics" for c, up in m.HIGHER_IS_BETTER.items())}""",
)
def rank_models(spark, sf):
    return m.rank_by_all(m.metric_table(preds(spark, sf), ["model"]))


def _misaligned(spark, sf):
    """Predictions in which one model lacks sure cases and another flips some targets."""
    sure = (F.col("model") == "score_share") & (F.col("probability") > 0.9)
    flip = (F.col("model") == "scramble") & (F.col("probability") < 0.05)
    out = preds(spark, sf).filter(~sure)
    return out.withColumn("target", F.when(flip, 1 - F.col("target")).otherwise(F.col("target")))


@register(
    "alignment_problems",
    f"""{SCORED}, off as (
  select id, model, case when model = 'scramble' and probability < 0.05 then 1 - target else target end as target from preds
  where not (model = 'score_share' and probability > 0.9))
select id, count(*) as rows, min(target) = max(target) as same from off group by 1
having count(distinct model) < 3 or min(target) <> max(target)""",
)
def alignment_problems(spark, sf):
    return m.alignment_problems(_misaligned(spark, sf), MODELS)


@register(
    "prediction_problems",
    f"""{SCORED} select count(*) filter (model = 'size_share' and probability > 0.7) as bad_targets, 0::bigint as bad_classes,
  count(*) filter (probability * 2 > 1 and model = 'scramble') as bad_probabilities,
  count(*) filter (model = 'score_share') as repeated_ids from preds""",
)
def prediction_problems(spark, sf):
    """Predictions spoiled in three ways; one model is listed twice."""
    p, model = F.col("probability"), F.col("model")
    good = preds(spark, sf)
    spoiled = good.withColumns(
        {
            "target": F.when((model == "size_share") & (p > 0.7), 2).otherwise(F.col("target")),
            "probability": F.when(model == "scramble", p * 2).otherwise(p),
        }
    )
    return checks.prediction_problems(spoiled.unionByName(spoiled.filter(model == "score_share")))


@register(
    "standardise_predictions",
    f"""{SCORED} select id::varchar as id, model, case model when 'scramble' then fold else '' end as tournament, fold, target, {r6_sql('probability')} as probability, prediction
from preds""",
)
def standardise_predictions(spark, sf):
    """Three tables of predictions that name and type their columns each in its own way."""
    scored = preds(spark, sf)
    shapes = {
        "score_share": {
            "Match_ID": F.concat(F.lit(" "), F.col("id").cast("string")), "y_true": F.col("target").cast("string"), "y_prob": F.col("probability"),
            "Predicted": F.col("prediction").cast("double"), "test_fold": F.concat("fold", F.lit(" ")),
        },
        "size_share": {
            "series_id": F.col("id"), "target_team_a_win": F.col("target").cast("double"), "predicted_probability_team_a_win": F.col("probability").cast("string"),
            "predicted_class": F.col("prediction"), "fold": F.col("fold"),
        },
        "scramble": {
            "series": F.col("id").cast("string"), "actual": F.col("target"), "probability": F.col("probability"), "y_pred": F.col("prediction").cast("string"),
            "evaluation_fold": F.col("fold"), "Open": F.lit("unused"), "event": F.concat(F.col("fold"), F.lit("  ")),
        },
    }
    parts = [m.standardise_predictions(scored.filter(F.col("model") == name).select(*[c.alias(n) for n, c in shape.items()]), name) for name, shape in shapes.items()]
    return _rounded(d.union_all(parts), ["probability"])


@register(
    "majority_baseline",
    f"""with {CONTESTS}, r as (
  select target, 'fold1_role' as role, case when tournament_order <= 1 then 'train' when tournament_order = 2 then 'test' else 'unused' end as part from contests
  union all
  select target, 'fold2_role', case when tournament_order <= 2 then 'train' when tournament_order = 3 then 'test' else 'unused' end from contests),
s as (select role, avg(target) filter (part = 'train') as tr, count(target) filter (part = 'test') as n, avg(target) filter (part = 'test') as te from r group by 1)
select role, {r6_sql('tr')} as train_positive_rate, (tr >= 0.5)::int as majority_class, n as test_rows,
  {r6_sql('case when tr >= 0.5 then te else 1 - te end')} as test_accuracy from s""",
)
def majority_baseline(spark, sf):
    df = d.assign_expanding_folds(views.contests(spark, sf), "tournament_order", 2)
    out = d.union_all([m.majority_baseline(df, f"fold{k}_role") for k in (1, 2)])
    return _rounded(out, ["train_positive_rate", "test_accuracy"])


def draws_sql(reps: int) -> str:
    """CTEs with the contests' places and the weights; a digest has the draws of two replicates."""
    return f"""{SCORED}, pos as (
  select id, fold, row_number() over (partition by fold order by id) - 1 as position, count(*) over (partition by fold) as size
  from (select distinct id, fold from preds)),
pairs as (select unnest(range(0, {(reps + 1) // 2})) as pair),
digests as (select pair, fold, size, md5('{SEED}|' || pair || '|' || fold || '|' || position) as d from pos cross join pairs),
weights as (
  select (2 * pair + odd)::smallint as rep, fold, (('0x' || substr(d, 1 + 16 * odd, 15))::bigint % size)::int as position, count(*)::int as weight
  from digests cross join (select unnest([0, 1]) as odd) where 2 * pair + odd < {reps} group by 1, 2, 3)"""


SAMPLE = f"""{draws_sql(REPS)}, placed as (
  select fold, position, model, target, prediction, probability, dense_rank() over (partition by model order by probability)::int as place,
    {LOSS} as loss from preds join pos using (id, fold)),
sample as (select * from weights join placed using (fold, position)),
sums as (
  select rep, model, sum(weight) filter (target = 0 and prediction = 0) as tn0, sum(weight) filter (target = 0 and prediction = 1) as fp0,
    sum(weight) filter (target = 1 and prediction = 0) as fn0, sum(weight) filter (target = 1 and prediction = 1) as tp0,
    sum(weight * loss) / sum(weight) as log_loss, sum(weight * (probability - target) * (probability - target)) / sum(weight) as brier_score
  from sample group by 1, 2),
scores as (
  select rep, model, place, sum(case when target = 1 then weight else 0 end)::int as pos, sum(case when target = 0 then weight else 0 end)::int as neg
  from sample group by 1, 2, 3),
lower as (select *, coalesce(sum(neg) over (partition by rep, model order by place rows between unbounded preceding and 1 preceding), 0) as below from scores),
areas as (
  select rep, model, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos::double * (below + neg / 2)) / (sum(pos)::double * sum(neg)) end as roc_auc
  from lower group by 1, 2),
counts as (
  select *, coalesce(tn0, 0)::bigint as tn, coalesce(fp0, 0)::bigint as fp, coalesce(fn0, 0)::bigint as fn, coalesce(tp0, 0)::bigint as tp from sums),
metrics as (
  select *, (tn + tp) / (tn + fp + fn + tp) as accuracy, case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end as f1
  from counts join areas using (rep, model))"""


@register(
    "bootstrap_draws",
    f"{draws_sql(LISTED_REPS)} select rep::int as rep, fold, position::bigint as position, weight::bigint as weight from weights",
)
def bootstrap_draws(spark, sf):
    """Every draw as a row: of fewer replicates, as the result is contests x replicates."""
    contests = written(preds(spark, sf).select("id", "fold").distinct(), "contests")
    return b.sample_weights(b.fold_positions(contests), LISTED_REPS, SEED)


@register(
    "replicate_metrics",
    f"{SAMPLE} select rep::int as rep, model, {_rounded_sql(m.METRICS)} from metrics",
)
def replicate_metrics(spark, sf):
    return _rounded(b.replicate_metrics(preds(spark, sf), REPS, SEED), m.METRICS)


def _long_sql(source, keys):
    return " union all ".join(f"select {keys}, '{c}' as metric, {c} as value from {source}" for c in m.METRICS)


ORIGINAL = metric_sql("preds", "model").replace("sums as", "o_sums as").replace("from sums", "from o_sums").replace(
    "scores as", "o_scores as").replace("from scores", "from o_scores").replace("ranked as", "o_ranked as").replace(
    "from ranked", "from o_ranked").replace("areas as", "o_areas as").replace("join areas", "join o_areas").replace(
    "counts as", "o_counts as").replace("from counts", "from o_counts").replace("metrics as", "o_metrics as")


@register(
    "bootstrap_ci",
    f"""{SAMPLE}, {ORIGINAL}, v as ({_long_sql('metrics', 'model')}), o as ({_long_sql('o_metrics', 'model')}),
s as (select model, metric, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi,
  count(value) as valid_samples, count(*) as total_samples from v group by 1, 2)
select model, metric, {r6_sql('o.value')} as original_value, {r6_sql('mean')} as bootstrap_mean, {r6_sql('sd')} as bootstrap_std,
  0.95::double as ci_level, {r6_sql('lo')} as ci_lower, {r6_sql('hi')} as ci_upper, valid_samples, total_samples from s join o using (model, metric)""",
)
def bootstrap_ci(spark, sf):
    scored = preds(spark, sf)
    out = b.bootstrap_ci(b.replicate_metrics(scored, REPS, SEED), m.metric_table(scored, ["model"]))
    return _rounded(out, ["original_value", "bootstrap_mean", "bootstrap_std", "ci_lower", "ci_upper"])


@register(
    "paired_compare",
    f"""{SAMPLE}, {ORIGINAL}, v as ({_long_sql('metrics', 'rep, model')}), o as ({_long_sql('o_metrics', 'model')}),
dd as (select x.model as model_1, y.model as model_2, metric,
    (x.value - y.value) * case when metric in ('accuracy', 'f1', 'roc_auc') then 1 else -1 end as d
  from v x join v y using (rep, metric) where x.model < y.model),
oo as (select x.model as model_1, y.model as model_2, metric,
    (x.value - y.value) * case when metric in ('accuracy', 'f1', 'roc_auc') then 1 else -1 end as d
  from o x join o y using (metric) where x.model < y.model),
s as (select model_1, model_2, metric, avg(d) as mean, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi,
    avg((d > 0)::int) as p1, avg((d < 0)::int) as p2, avg((d = 0)::int) as tie,
    least(1.0, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))) as tail, count(d) as valid_samples from dd group by 1, 2, 3)
select model_1, model_2, metric, {r6_sql('oo.d')} as original_difference, {r6_sql('mean')} as bootstrap_mean_difference,
  0.95::double as ci_level, {r6_sql('lo')} as ci_lower, {r6_sql('hi')} as ci_upper, lo > 0 or hi < 0 as ci_excludes_zero,
  case when lo > 0 then model_1 || ' better' when hi < 0 then model_2 || ' better' else 'uncertain / overlaps zero' end as ci_direction,
  {r6_sql('p1')} as probability_model_1_better, {r6_sql('p2')} as probability_model_2_better, {r6_sql('tie')} as probability_tie,
  {r6_sql('tail')} as two_sided_tail_p, valid_samples from s join oo using (model_1, model_2, metric)""",
)
def paired_compare(spark, sf):
    scored = preds(spark, sf)
    out = b.paired_compare(
        b.replicate_metrics(scored, REPS, SEED), m.metric_table(scored, ["model"]), MODELS
    )
    return _rounded(
        out,
        [
            "original_difference",
            "bootstrap_mean_difference",
            "ci_lower",
            "ci_upper",
            "probability_model_1_better",
            "probability_model_2_better",
            "probability_tie",
            "two_sided_tail_p",
        ],
    )
