import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.evaluation import bootstrap as b
from seriesmill.evaluation import metrics as m
from seriesmill.operators.checks import prediction_problems, validate_predictions

SCHEMA = "id long, fold string, model string, target int, probability double"


def random_predictions(seed=1, n=200, models=("x", "y")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        for mod in models:
            p = min(1.0, max(0.0, rng.choice([0.0, 1.0, 0.5, rng.random(), 0.3 + 0.4 * y])))
            rows.append((i, f"fold_{i % 2}", mod, y, p))
    return rows


def brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    if not pos or not neg:
        return None
    won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return won / (len(pos) * len(neg))


@pytest.mark.parametrize(
    "counts,want",
    [
        ((18, 6, 15, 27), (0.6818, 0.7200)),
        ((16, 8, 12, 30), (0.6970, 0.7500)),
        ((10, 14, 10, 32), (0.6364, 0.7273)),
    ],
)
def test_published_confusion_gives_published_metrics(spark, counts, want):
    df = spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")
    r = m.with_rates(df).first()
    assert (round(r["accuracy"], 4), round(r["f1"], 4), r["n"]) == (*want, 66)


def test_no_denominator_is_zero(spark):
    r = m.with_rates(spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 1)


def test_metrics_match_brute_force(spark):
    rows = random_predictions()
    df = m.with_decisions(spark.createDataFrame(rows, SCHEMA))
    got = {(r["model"], r["fold"]): r for r in m.metrics_by_scope(df).collect()}
    assert len(got) == 6
    eps = m.EPSILON
    for (mod, fold), r in got.items():
        mine = [(y, p) for _, f, x, y, p in rows if x == mod and fold in ("pooled", f)]
        clip = [(y, min(max(p, eps), 1 - eps)) for y, p in mine]
        assert math.isclose(r["log_loss"], -sum(math.log(p if y else 1 - p) for y, p in clip) / len(mine))
        assert math.isclose(r["brier_score"], sum((p - y) ** 2 for y, p in mine) / len(mine))
        assert math.isclose(r["roc_auc"], brute_auc(mine))
        assert math.isclose(r["accuracy"], sum((p >= 0.5) == (y == 1) for y, p in mine) / len(mine))


def test_auc_symmetry_and_one_class(spark):
    df = spark.createDataFrame(random_predictions(3), SCHEMA)
    up = {r["model"]: r["roc_auc"] for r in m.roc_auc(df, ["model"]).collect()}
    down = m.roc_auc(df.withColumn("probability", 1 - F.col("probability")), ["model"]).collect()
    for r in down:
        assert math.isclose(up[r["model"]] + r["roc_auc"], 1)
    only = m.roc_auc(df.filter(F.col("target") == 1), ["model"]).collect()
    assert [r["roc_auc"] for r in only] == [None, None]


def test_weights_count_like_repeats(spark):
    rows = random_predictions(4, n=60)
    df = m.with_decisions(spark.createDataFrame(rows, SCHEMA)).withColumn("w", F.col("id") % 4)
    repeated = df.withColumn("k", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))))
    a = {r["model"]: r for r in m.metric_table(df, ["model"], "w").collect()}
    for r in m.metric_table(repeated, ["model"]).collect():
        for c in m.METRICS:
            assert math.isclose(a[r["model"]][c], r[c])


def test_roc_points_reach_both_corners(spark):
    rows = random_predictions(5, n=50, models=("x",))
    points = m.roc_points(spark.createDataFrame(rows, SCHEMA), ["model"]).collect()
    assert len(points) == len({r[4] for r in rows}) + 1
    for r in points:
        if r["threshold"] is None:
            assert (r["fpr"], r["tpr"]) == (0, 0)
            continue
        for y, name in ((1, "tpr"), (0, "fpr")):
            ps = [p for *_, t, p in rows if t == y]
            assert math.isclose(r[name], sum(p >= r["threshold"] for p in ps) / len(ps))


def test_calibration_matches_numpy(spark):
    rows = random_predictions(6, n=120)
    got = m.calibration(spark.createDataFrame(rows, SCHEMA), ["model"]).collect()
    for mod in ("x", "y"):
        p = np.array([r[4] for r in rows if r[2] == mod])
        y = np.array([r[3] for r in rows if r[2] == mod])
        slot = np.searchsorted(np.percentile(p, [20, 40, 60, 80]), p)
        want = {n: ((slot == k).sum(), p[slot == k].mean(), y[slot == k].mean()) for n, k in enumerate(sorted(set(slot)), 1)}
        mine = {r["bin"]: (r["n"], r["mean_predicted_probability"], r["observed_rate"]) for r in got if r["model"] == mod}
        assert mine.keys() == want.keys()
        for k in want:
            assert np.allclose(mine[k], want[k])


def test_alignment_and_validation(spark):
    df = m.with_decisions(spark.createDataFrame(random_predictions(7, n=20), SCHEMA))
    assert m.check_aligned(df, ["x", "y"]) is df and validate_predictions(df) is df
    with pytest.raises(ValueError, match="not aligned"):
        m.check_aligned(df.filter("not (model = 'x' and id = 3)"), ["x", "y"])
    with pytest.raises(ValueError, match="bad_probabilities"):
        validate_predictions(df.withColumn("probability", F.col("probability") + 0.7))
    assert prediction_problems(df.union(df)).first()["repeated_ids"] == 40


def test_draws_keep_fold_sizes(spark):
    contests = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(47)], "id long, fold string")
    w = b.sample_weights(b.fold_positions(contests), 25, 7)
    sums = w.groupBy("rep", "fold").agg(F.sum("weight").alias("n"), F.max("position").alias("top")).collect()
    assert len(sums) == 50
    assert all(r["n"] == (30 if r["fold"] == "a" else 17) and r["top"] < r["n"] for r in sums)


def test_draws_are_listed_where_they_are_made(spark):
    """No weight is shuffled for the list, and the tasks hold few replicates of a large fold."""
    contests = spark.createDataFrame([(i, "a" if i < 3000 else None) for i in range(3003)], "id long, fold string")
    places = b.fold_positions(contests)
    w = b.sample_weights(places, 25, 7)
    assert "FlatMapGroups" not in w._jdf.queryExecution().toString()
    got = {(r["rep"], r["fold"], r["position"]): r["weight"] for r in w.collect()}
    want = {}
    for rep in range(25):
        for fold, size in (("a", 3000), ("", 3)):
            for slot in range(size):
                digest = hashlib.md5(f"7|{rep // 2}|{fold}|{slot}".encode()).hexdigest()
                place = (rep, fold or None, int(digest[16 * (rep % 2) :][:15], 16) % size)
                want[place] = want.get(place, 0) + 1
    assert got == want


def test_large_folds_are_drawn_in_few_replicates(spark, monkeypatch):
    """The weights that a task holds and writes follow contests x replicates, not the square of a fold."""
    contests = spark.createDataFrame([(i, "a" if i < 2500 else "b") for i in range(2600)], "id long, fold string")
    places = b.fold_positions(contests)
    monkeypatch.setattr(b, "WEIGHTS_AT_ONCE", 10_000)
    units = b._units(places, 10).collect()
    assert sorted((r["fold"], r["rep"], r["until"]) for r in units) == [("a", 0, 4), ("a", 4, 8), ("a", 8, 10), ("b", 0, 10)]
    blocks = b._drawn(b._units(places, 10), 7).collect()
    assert sum(len(r["weights"]) for r in blocks) == 10 * 2600
    scores = places.withColumn("one", F.lit(1))
    got = {(r["id"]): list(b.unpacked(r["weights"], 10)) for r in b.weighted_scores(scores, places, 10, 7).collect()}
    listed = places.join(b.sample_weights(places, 10, 7), ["fold", "position"]).collect()
    want = {}
    for r in listed:
        want.setdefault(r["id"], [0] * 10)[r["rep"]] = r["weight"]
    assert got == want


def test_a_written_list_of_draws_is_short(spark, tmp_path):
    """About a byte for each of its rows (11 to 12 in memory), whatever the size of a fold."""
    places = b.fold_positions(spark.range(60_000).selectExpr("id", "'a' as fold"))
    b.sample_weights(places, 64, 7).write.parquet(f"{tmp_path}/list")
    rows = spark.read.parquet(f"{tmp_path}/list").agg(F.count(F.lit(1)), F.sum("weight")).first()
    assert rows[1] == 64 * 60_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2 * rows[0]


def test_bootstrap_pairs_the_draws(spark):
    """Two copies of one model differ by nothing in every replicate."""
    rows = random_predictions(8, n=60, models=("x",))
    both = spark.createDataFrame(rows + [(i, f, "y", t, p) for i, f, _, t, p in rows], SCHEMA)
    df = m.with_decisions(both)
    reps = b.replicate_metrics(df, reps=10)
    out = b.paired_compare(reps, m.metric_table(df, ["model"]), ["x", "y"]).collect()
    assert len(out) == 5
    for r in out:
        # Sums of losses may differ in the last bit with the order of addition.
        assert abs(r["ci_lower"]) < 1e-12 and abs(r["ci_upper"]) < 1e-12
        if r["metric"] in ("accuracy", "f1", "roc_auc"):
            assert (r["probability_tie"], r["two_sided_tail_p"]) == (1, 1)
            assert r["ci_direction"] == "uncertain / overlaps zero" and not r["ci_excludes_zero"]


def test_weights_stay_in_the_task_that_draws_them(spark, monkeypatch):
    """Runs of scores with ties across their ends, few replicates at once, a missing fold, a contest of one model: by brute force."""
    monkeypatch.setattr(b, "WEIGHTS_AT_ONCE", 300 * 6)
    monkeypatch.setattr(b, "RUN_ROWS", 32)
    seen = []
    monkeypatch.setattr(b, "written", lambda df, name, real=b.written: seen.append(df) or real(df, name))
    rows = random_predictions(5, n=300)
    odd = [(900, None, "x", 1, 0.4), (901, "fold_0", "x", 1, 0.25)]
    preds = m.with_decisions(spark.createDataFrame(rows + odd, SCHEMA))
    out = b.replicate_metrics(preds, 11, 7)
    got = {(r["model"], r["rep"]): r for r in out.collect()}
    assert not any(x in df._jdf.queryExecution().toString() for df in (*seen, out) for x in ("FlatMapCoGroups", "weights"))
    places = {"fold_0": [i for i in range(300) if i % 2 == 0] + [901], "fold_1": [i for i in range(300) if i % 2]}
    for rep in range(11):
        drawn = []
        for fold, ids in places.items():
            for slot in range(len(ids)):
                digest = hashlib.md5(f"7|{rep // 2}|{fold}|{slot}".encode()).hexdigest()
                drawn.append(ids[int(digest[16 * (rep % 2) :][:15], 16) % len(ids)])
        for model in ("x", "y"):
            known = {i: (t, p) for i, f, mod, t, p in rows + odd if mod == model and f}
            pairs = [known[i] for i in drawn if i in known]
            r = got[model, rep]
            assert r["roc_auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)
            assert r["accuracy"] == pytest.approx(np.mean([t == (p >= 0.5) for t, p in pairs]), abs=1e-12)
            assert r["brier_score"] == pytest.approx(np.mean([(p - t) ** 2 for t, p in pairs]), abs=1e-12)
            eps = m.EPSILON
            want = [-math.log(min(max(p, eps), 1 - eps)) if t else -math.log(1 - min(max(p, eps), 1 - eps)) for t, p in pairs]
            assert r["log_loss"] == pytest.approx(np.mean(want), abs=1e-12)


def test_prediction_synonyms(spark):
    raw = spark.createDataFrame([(" s1 ", "1", 0.7, 1.0, "f ")], "Match_ID string, actual string, y_prob double, predicted double, test_fold string")
    r = m.standardise_predictions(raw, "mine").first()
    assert (r["id"], r["target"], r["prediction"], r["fold"], r["tournament"]) == ("s1", 1, 1, "f", "")
    with pytest.raises(ValueError):
        m.standardise_predictions(raw.drop("y_prob"), "mine")


def test_area_of_heavy_weights(spark):
    rows = [("m", 0.2, 1, 4_000_000_000), ("m", 0.2, 0, 4_000_000_000), ("m", 0.8, 1, 4_000_000_000), ("m", 0.8, 0, 4_000_000_000)]
    preds = spark.createDataFrame(rows, "model string, probability double, target int, weight long")
    assert m.roc_auc(preds, ["model"], "weight").first()["roc_auc"] == 0.5
