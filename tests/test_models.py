import threading
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.models import fit, preprocess
from seriesmill.models.preprocess import fit_median_imputer, fit_standard_scaler


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x, z = rng.normal(), rng.normal()
        y = int(x + 0.5 * rng.normal() > 0.2)
        rows.append((i, 1 + i // 80, y, float(x), None if i % 9 == 0 else float(z), None, 3.0))
    df = spark.createDataFrame(rows, "id long, period int, target int, x double, z double, never double, same double")
    from seriesmill.operators.dataset import assign_expanding_folds

    return assign_expanding_folds(df, "period", 2).cache()


FEATURES = ["x", "z", "never", "same"]


def test_imputer_and_scaler(table):
    train = table.filter("fold1_role = 'train'")
    imputer = fit_median_imputer(train, FEATURES)
    z = np.array([r["z"] for r in train.collect() if r["z"] is not None])
    assert imputer.kept == ["x", "z", "same"] and np.isclose(imputer.medians["z"], np.median(z))
    filled = imputer.transform(train)
    scaler = fit_standard_scaler(filled, imputer.kept)
    values = np.array([r["z"] for r in filled.collect()])
    assert np.allclose(scaler.moments["z"], (values.mean(), values.std()))
    assert scaler.moments["same"] == (3.0, 1.0)


@pytest.mark.parametrize("copies", [1, 10])
def test_logistic_gradient_vanishes(table, copies):
    """At the optimum of the penalised sum of losses, for few and for many rows."""
    train = table.filter("fold2_role = 'train'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    train = train.withColumn("x", F.col("x") + F.col("copy") / 100)
    fitted = fit.fit_logistic(train, FEATURES, "f", c=1.0)
    rows = fitted.prepare(train).select("features_vector", "target").collect()
    x = np.array([r["features_vector"].toArray() for r in rows])
    y = np.array([r["target"] for r in rows])
    w = fitted.model.coefficients.toArray()
    gradient = w + x.T @ (1 / (1 + np.exp(-x @ w)) - y)
    assert x.shape[1] == 4 and np.abs(gradient).max() < 1e-3


def test_folds_score_test_rows_only(spark, table):
    scored, fitted = fit.run_temporal_folds(table, FEATURES, 2, fit.fit_logistic, ["id"])
    got = scored.groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.avg("correct").alias("ok"))
    rows = {r["fold"]: r for r in got.collect()}
    assert (rows["fold_1"]["n"], rows["fold_1"]["lo"]) == (80, 80)
    assert (rows["fold_2"]["n"], rows["fold_2"]["lo"]) == (80, 160)
    assert rows["fold_2"]["ok"] > 0.75
    coefficients = fit.coefficient_table(spark, fitted)
    assert coefficients.count() == 6
    assert coefficients.orderBy(F.desc("absolute_coefficient")).first()["feature"] == "x"


def test_forest_and_mlp(spark, table):
    scored, fitted = fit.run_temporal_folds(table, FEATURES, 2, partial(fit.fit_forest, trees=10), ["id"])
    sums = fit.importance_table(spark, fitted).groupBy("fold").agg(F.sum("importance").alias("s")).collect()
    assert all(np.isclose(r["s"], 1) for r in sums) and scored.count() == 160
    scored, fitted = fit.run_temporal_folds(table, ["x", "z"], 2, partial(fit.fit_mlp, max_iter=20), ["id"])
    losses = fit.training_diagnostics(spark, fitted).filter("fold = 'fold_1'").orderBy("iteration").collect()
    assert losses[-1]["loss"] < losses[0]["loss"] and scored.count() == 160


def test_empty_fold_is_an_error(table):
    with pytest.raises(ValueError, match="test2"):
        fit.run_temporal_folds(table.filter("period < 3"), FEATURES, 2, fit.fit_logistic, ["id"])


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_logistic_of_equal_rows(spark, n):
    """One distinct row: the intercept alone must carry the log odds, at any size."""
    train = spark.range(n).select(F.lit(1).alias("target"), F.lit(1.0).alias("x"))
    fitted = fit.fit_logistic(train, ["x"], "f")
    w = fitted.model.coefficients.toArray()
    assert w[0] == 0 and abs(w[-1] - n / (1 + np.exp(w[-1]))) < 1e-2


def test_a_fold_is_fitted_once(spark, tmp_path):
    from seriesmill.models import store

    rows = [(i, i % 2 if i % 5 else 1 - i % 2, float(i % 7), None if i % 9 == 0 else float(i % 2) + i % 3, "train" if i < 60 else "test") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, target int, x double, y double, fold1_role string")
    fits = []

    def counted(train, features, fold):
        fits.append(fold)
        return fit.fit_logistic(train, features, fold)

    kept = store.kept(counted, str(tmp_path), "logistic")
    first, one = fit.run_temporal_folds(df, ["x", "y"], 1, kept, ["id"])
    again, two = fit.run_temporal_folds(df.repartition(7), ["x", "y"], 1, kept, ["id"])
    assert fits == ["fold_1"] and one[0].history == two[0].history
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert fit.coefficient_table(spark, one).collect() == fit.coefficient_table(spark, two).collect()
    fit.run_temporal_folds(df.withColumn("x", F.when(F.col("id") == 3, 9.0).otherwise(F.col("x"))), ["x", "y"], 1, kept, ["id"])
    assert len(fits) == 2  # another training row, another fit


def test_training_rows_are_dealt_to_the_cores(spark):
    """A table of one partition is fitted and scored by many tasks; a small one stays as it is."""
    one = spark.range(45_000).coalesce(1)
    assert fit.dealt(one, 45_000).rdd.getNumPartitions() == 5 and fit.dealt(one, 45_000).count() == 45_000
    assert fit.dealt(one, fit.LEAST_ROWS).rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    assert fit.dealt(one, 50 * fit.TASK_ROWS).rdd.getNumPartitions() == max(50, 2 * cores)


def test_many_rows_are_not_doubled(spark, table):
    """Of many rows every other one is mirrored, not each one added: the optimum is the same."""
    train = table.filter("fold2_role = 'train'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(80))))
    train = train.withColumn("x", F.col("x") + F.col("copy") / 100)
    n = train.count()
    assert n > fit.LEAST_ROWS
    fitted = fit.fit_logistic(train, FEATURES, "f", c=1.0)
    rows = fitted.prepare(train).select("features_vector", "target").collect()
    x = np.array([r["features_vector"].toArray() for r in rows])
    y = np.array([r["target"] for r in rows])
    w = fitted.model.coefficients.toArray()
    gradient = w + x.T @ (1 / (1 + np.exp(-x @ w)) - y)
    assert x.shape[1] == 4 and np.abs(gradient).max() < 1e-2 and abs(w[-1]) > 1e-3
    signs = fit._mirrored(fitted.columns(fit.dealt(train, n)), fitted.features, n).groupBy("__sign").count().collect()
    assert sum(r["count"] for r in signs) == n and abs(signs[0]["count"] - signs[1]["count"]) <= n // 100


@pytest.mark.parametrize("accuracy, few", [(10_000, 1 << 18), (10_000, 16), (20, 16)])
def test_medians_side_by_side(spark, monkeypatch, accuracy, few):
    """Ties, holes, even and odd counts, brackets that are counted and columns without values; no row per cell."""
    from seriesmill.operators import ordering

    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    monkeypatch.setattr(ordering, "BRACKET_ROWS", few)
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(20_001, 3))
    rows = [(float(a), None if i % 3 == 0 else float(round(b, 1)), float(c > 0), None) for i, (a, b, c) in enumerate(wide)]
    df = spark.createDataFrame(rows, "`a b` double, b double, c double, d double").repartition(4)
    monkeypatch.setattr(ordering, "exact_quantiles", None)
    got = preprocess.fit_median_imputer(df, ["a b", "b", "c", "d"])
    want = [np.median([r[i] for r in rows if r[i] is not None]) for i in range(3)]
    assert got.kept == ["a b", "b", "c"] and [got.medians[c] for c in got.kept] == want


def test_tasks_of_many_steps_fill_all_cores(spark):
    """With ``whole`` no step ends with a few tasks on a few cores; fewer tasks than cores stay as they are."""
    one, cores = spark.range(45_000).coalesce(1), spark.sparkContext.defaultParallelism
    n = (2 * cores + 1) * fit.TASK_ROWS
    assert fit.dealt(one, n).rdd.getNumPartitions() == 2 * cores + 1
    assert fit.dealt(one, n, whole=True).rdd.getNumPartitions() == 3 * cores
    assert fit.dealt(one, 2 * fit.LEAST_ROWS, whole=True).rdd.getNumPartitions() == 2
    assert fit.dealt(one, n, whole=True).count() == 45_000


def test_folds_side_by_side(table):
    """Both folds are under way at once, and come out as one by one; an error of a fold is raised."""
    both = threading.Barrier(2)

    def met(train, features, fold):
        both.wait(timeout=60)
        return fit.fit_mlp(train, features, fold, max_iter=5)

    one, first = fit.run_temporal_folds(table, ["x", "z"], 2, partial(fit.fit_mlp, max_iter=5), ["id"])
    two, again = fit.run_temporal_folds(table, ["x", "z"], 2, met, ["id"], at_once=2)
    assert [f.fold for f in again] == ["fold_1", "fold_2"]
    assert all(np.allclose(a.history, b.history) for a, b in zip(first, again))
    assert [r["id"] for r in one.orderBy("id").collect()] == [r["id"] for r in two.orderBy("id").collect()] == list(range(80, 240))

    def fails(train, features, fold):
        raise ArithmeticError(fold)

    with pytest.raises(ArithmeticError, match="fold_1"):
        fit.run_temporal_folds(table, ["x", "z"], 2, fails, ["id"], at_once=2)


def test_scaler_of_many_features(spark):
    """Features go through in groups that Spark compiles as a whole; all of them come out, in their order."""
    k = 2 * preprocess.SCALED_AT_ONCE + 1
    values = np.random.default_rng(5).normal(size=(500, k)) * np.arange(k) + 2
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"`a {i}` double" for i in range(k)))
    passes = []

    class Counted:
        def agg(self, *sums):
            passes.append(len(sums))
            return df.agg(*sums)

    got = fit_standard_scaler(Counted(), df.columns).moments
    assert list(got) == df.columns and got["a 0"] == (2.0, 1.0) and passes == [42, 42, 3]
    assert np.allclose([got[c] for c in df.columns[1:]], np.stack([values.mean(0), values.std(0)], 1)[1:])


def forest_rows(spark, n=3000):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(n), rng.integers(0, 4, n), rng.normal(size=n), np.full(n, 2.5)])
    y = (x[:, 0] + 0.2 * x[:, 1] + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, target int"), x, y


def test_forest_of_many_rows(spark, monkeypatch):
    """MLlib is not fitted on the rows, and both forests say the same."""
    fitted_on = []
    real = fit.RandomForestClassifier.fit
    monkeypatch.setattr(fit.RandomForestClassifier, "fit", lambda self, df, *a: fitted_on.append(df.count()) or real(self, df, *a))
    rows, _, y = forest_rows(spark)
    found = {}
    for least in (1000, 10_000):
        monkeypatch.setattr(fit, "LEAST_ROWS", least)
        forest = fit.fit_forest(rows, ["a", "b", "c", "d"], "fold_1", trees=60)
        p = np.array([r["probability"] for r in forest.score(rows, ["id"]).orderBy("id").collect()])
        found[least] = (forest.model.featureImportances.toArray(), p, np.mean((p >= 0.5) == y), forest.model.getNumTrees)
    assert fitted_on == [2, 3000]
    (own, p, right, trees), (want, q, wanted, _) = found.values()
    assert trees == 60 and abs(own.sum() - 1) < 1e-9 and own[3] == 0
    assert np.abs(own - want).max() < 0.06 and np.abs(p - q).mean() < 0.03 and abs(right - wanted) < 0.02


def test_trees_add_up(spark, tmp_path, monkeypatch):
    """Each node's classes are those of the rows drawn for its tree that its path leads to, its split has the largest gain."""
    from seriesmill.models import forest as fr

    monkeypatch.setattr(fit, "LEAST_ROWS", 1000)
    monkeypatch.setattr(fr, "CHUNK_ROWS", 700)
    kept = []
    monkeypatch.setattr(fr, "written", lambda df, name, real=fr.written: kept.append(real(df, name)) or kept[-1])
    rows, _, _ = forest_rows(spark)
    names = ["a", "b", "c", "d"]
    model = fit.fit_forest(rows, names, "fold_1", trees=5, bins=16).model
    model.write().save(f"{tmp_path}/m")
    plain, binned = kept
    assert sorted(r["rows"] for r in binned.collect())[-1] <= 700 and binned.agg(F.sum("rows")).first()[0] == 3000
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{tmp_path}/m/data").collect()}
    values = {f: np.array([r[f] for r in plain.select(f).collect()]) for f in names}
    cuts = [fr.thresholds(values[f], 16) for f in names]
    chunks = [(r["chunk"], np.frombuffer(r["body"], np.uint8).reshape(4, r["rows"])) for r in binned.collect()]
    for tree in range(5):
        drawn = np.concatenate([codes[:, fr._drawn(42, c, tree, codes.shape[1])] for c, codes in chunks], axis=1)

        def walk(node, own):
            n = nodes[tree, node]
            assert n["impurityStats"] == [float((own[0] % 2 == t).sum()) for t in (0, 1)] and n["rawCount"] == own.shape[1] >= 2
            if n["leftChild"] < 0:
                return 1
            f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            left = own[f] // 2 <= int(np.flatnonzero(cuts[f] == at)[0])
            assert n["gain"] > 0
            return 1 + max(walk(n["leftChild"], own[:, left]), walk(n["rightChild"], own[:, ~left]))

        assert 1 < walk(0, drawn) <= 5


def test_forests_are_scored_in_batches(spark):
    """The very numbers of MLlib's model, without its pass over the trees for each row."""
    rows, _, _ = forest_rows(spark, 700)
    forest = fit.fit_forest(rows, ["a", "b", "c", "d"], "fold_1", trees=30)
    scored = forest.score(rows, ["id", "a"])
    assert scored.columns[:5] == ["id", "a", "target", "fold", "probability"] and "UDF(" not in scored._jdf.queryExecution().toString()
    want = {r["id"]: r["p"] for r in forest.model.transform(forest.prepare(rows)).select("id", fit.vector_to_array("probability")[1].alias("p")).collect()}
    assert {r["id"]: r["probability"] for r in scored.collect()} == want
    with pytest.raises(Exception, match="not a number"):
        forest.score(rows.withColumn("b", F.lit(float("nan"))), ["id"]).collect()


def test_best_splits_by_brute_force():
    from seriesmill.models.forest import best_splits

    rng = np.random.default_rng(5)
    counts = rng.integers(0, 6, (8, 3, 5, 2))
    counts[:, 1:] = counts[:, :1, ::-1]  # each feature has the same rows
    cuts = rng.integers(0, 5, (8, 3))

    def gini(c):
        return 1 - sum((x / max(1, sum(c))) ** 2 for x in c)

    for node, found in enumerate(best_splits(counts, cuts, 2)):
        best = 0.0
        for f in range(3):
            for s in range(cuts[node, f]):
                a, b = counts[node, f, : s + 1].sum(0), counts[node, f, s + 1 :].sum(0)
                if min(a.sum(), b.sum()) >= 2:
                    best = max(best, gini(a + b) - (a.sum() * gini(a) + b.sum() * gini(b)) / (a + b).sum())
        assert found[2] == pytest.approx(best, abs=1e-12)
        f, s = int(found[3]), int(found[4])
        if best > 0:
            assert (found[5:7] == counts[node, f, : s + 1].sum(0)).all() and (found[5:7] + found[7:9] == found[:2]).all()


@pytest.mark.parametrize("values,want", [([1, 1, 2, 4], [1.5, 3.0]), ([7, 7], []), (list(range(100)), [24.5, 49.5, 74.5])])
def test_thresholds(values, want):
    from seriesmill.models.forest import thresholds

    assert thresholds(np.array(values, float), 4).tolist() == want
