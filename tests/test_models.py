"""Trained operators: invariants on a small table with one strong, one weak and one useless feature."""

import inspect
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sondage.operators import landmarks, metrics, recommend, seeding, training
from sondage.sources.knowledge import KnowledgeBase

FEATURES = ["strong", "weak", "noise", "colour"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    n = 240
    y = rng.integers(0, 2, n)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "strong": y * 4.0 + rng.normal(size=n), "weak": y * 0.5 + rng.normal(size=n),
        "noise": rng.normal(size=n), "colour": rng.choice(["red", "blue"], n), "part": rng.choice(["a", "b"], n), "y": np.where(y, "yes", "no"),
    }))


@pytest.fixture(scope="module")
def run(df):
    seen = []
    out = training.train_models(
        df, "id", FEATURES, "y", algorithms=["LogisticRegression", "RandomForest", "NoSuchModel"],
        progress=lambda name, status: seen.append((name, status)))
    out.seen = seen
    return out


def test_leaderboard_keeps_failures(run):
    rows = {r["model"]: r for r in run.board.collect()}
    assert rows["NoSuchModel"]["status"].startswith("failed") and rows["NoSuchModel"]["f1"] is None
    good = [rows[m] for m in ("LogisticRegression", "RandomForest")]
    assert all(0.85 < r["f1"] <= 1.0 and 0.9 < r["roc_auc"] <= 1.0 and r["status"] == "ok" for r in good)
    assert min(r["rank"] for r in good) == 1 and len(run.seen) == 3
    assert run.predictions.count() == 2 * run.test.count()


def test_importances_name_the_strong_feature(run, spark):
    assert run.names == ["strong", "weak", "noise", "colour_blue", "colour_red"]
    for name in ("RandomForest", "LogisticRegression"):
        rows = training.feature_importance(run.models[name], run.names, spark).collect()
        assert rows[0]["feature"] == "strong" and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_permutation_importance(run):
    rows = {r["feature"]: r["importance"] for r in training.permutation_importance(
        run.models["LogisticRegression"], run.test, "id", run.names, 2).collect()}
    assert set(rows) == set(run.names) and rows["strong"] > 0.2 and max(rows, key=rows.get) == "strong"
    assert abs(rows["noise"]) < 0.15


def test_local_attribution(run, spark):
    row = run.test.orderBy("id").select(vector_to_array("features")).first()[0]
    rows = training.local_attribution(run.models["LogisticRegression"], row, [1.0] * len(row), run.names, spark, samples=500)
    first = rows.first()
    assert first["feature"] == "strong" and first["contribution"] > 0


def test_saved_models_score_alike(run, df, tmp_path):
    model = run.pipeline("LogisticRegression")
    training.save_model(model, str(tmp_path / "m"))
    again = training.load_model(str(tmp_path / "m"))
    a, b = training.batch_score(model, df, "id"), training.batch_score(again, df, "id")
    assert a.exceptAll(b).count() == 0 and a.count() == df.count()


def test_benchmark_fits_each_fold_once(df):
    p = training.cross_validate(df, "id", ["strong", "weak"], "y", ["LogisticRegression", "NaiveBayes", "KNN"], folds=2)
    assert p.groupBy("model").count().where(F.col("count") != df.count()).count() == 0
    rows = {r["model"]: r for r in training.benchmark(p, with_auc=True).collect()}
    assert set(rows) == {"LogisticRegression", "NaiveBayes", "KNN"}
    assert sum(r["is_best"] for r in rows.values()) == 1
    for r in rows.values():
        assert r["cv_folds"] == 2 and len(r["f1_weighted_scores"]) == 2
        assert r["f1_weighted"] == pytest.approx(np.mean(r["f1_weighted_scores"])) and 0.85 < r["roc_auc"] <= 1
    assert training.top_models(training.benchmark(p), 2).count() == 2


def test_elimination_keeps_the_strong_feature(run):
    kept = training.recursive_elimination(run.train, len(run.names), keep=2)
    assert len(kept) == 2 and 0 in kept


def test_curves(df):
    curve = training.learning_curve(df, "id", ["strong", "weak"], "y", LogisticRegression(maxIter=10), [0.3, 1.0], folds=2).collect()
    assert sorted(r["share"] for r in curve) == [0.3, 1.0] and all(0.8 < r["validation_score"] <= 1 for r in curve)
    depth = training.validation_curve(df, "id", ["strong", "noise"], "y", [2, None], folds=2, trees=3).collect()
    assert [r["max_depth"] for r in depth] == ["2", "unbounded"]
    assert all(0 <= r["validation_score"] <= 1 for r in depth) and min(r["train_score"] for r in depth) > 0.9


def test_regression_path(df):
    rows = df.withColumn("target", F.col("strong") * 3 + F.col("noise"))
    board = training.train_models(
        rows, "id", ["strong", "noise"], "target", "regression", ["LinearRegression", "DecisionTree"]).board.collect()
    best = min(board, key=lambda r: r["rank"])
    assert best["model"] == "LinearRegression" and best["r2"] > 0.999


def test_seeding_twice_changes_nothing_and_recommends(df, spark):
    once = seeding.seed(df, "part", "id", ["strong", "weak"], "y", algorithms=["LogisticRegression", "NaiveBayes"], folds=2)
    kb = once
    assert kb.experiments.count() == 2 and kb.results.count() == 4
    twice = kb.upsert(KnowledgeBase(
        kb.experiments, kb.features.join(kb.experiments.select("experiment_id", "dataset_hash"), "experiment_id"),
        kb.results.join(kb.experiments.select("experiment_id", "dataset_hash"), "experiment_id")))
    assert twice.experiments.count() == 2 and twice.features.count() == kb.features.count()
    names = kb.feature_names()
    assert len(names) == 20 and {f"l4_landmark_{n}" for n in ("dt", "nb", "knn", "svm")} < set(names)
    found = recommend.recommend(df.select("id", "strong", "weak", "y"), "y", kb, key="id")
    assert {r["feature_name"] for r in found["meta"].collect()} == set(names)
    told = found["report"].first()
    assert told["algorithm"] == found["ranking"].where("rank = 1").first()["algorithm"] and told["confidence"]
    assert "Small dataset" in told["explanation"] and "2 similar" in told["explanation"]
    out = recommend.recommend(df.select("strong", "weak", "y"), "y", kb)
    ranking = out["ranking"].orderBy("rank").collect()
    assert [r["algorithm"] for r in ranking][0] in recommend.DEFAULT_ALGORITHMS
    assert out["similar"].count() == 2 and out["health"].first()["status"] in ("critical", "warning", "minor", "healthy")


def test_defaults_are_the_references(spark):
    catalog = training.benchmark_catalog()
    assert set(catalog) | {"KNN"} == set(training.BENCHMARK_7)
    forest, boosted = catalog["RandomForest"], catalog["GradientBoosting"]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, training.UNBOUNDED_DEPTH)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (100, 3, 0.1)
    assert catalog["LogisticRegression"].getMaxIter() == 1000
    fast = training.model_catalog("classification")
    assert (fast["RandomForest"].getNumTrees(), fast["RandomForest"].getMaxDepth()) == (80, training.UNBOUNDED_DEPTH)
    assert fast["GradientBoosting"].getMaxIter() == 80 and fast["LogisticRegression"].getMaxIter() == 500
    for call, wanted in ((training.cross_validate, {"folds": 5}), (training.learning_curve, {"folds": 5}), (seeding.seed, {"folds": 5}),
                         (training.validation_curve, {"folds": 5, "trees": 80}), (training.recursive_elimination, {"step": 1}),
                         (landmarks.linear_svm, {"max_iter": 2000})):
        defaults = inspect.signature(call).parameters
        assert {k: defaults[k].default for k in wanted} == wanted


def test_registered_queries_keep_the_defaults():
    import bindings.training as bound

    source = inspect.getsource(bound)
    for name in ("landmark_svm", "landmark_gap", "benchmark_5", "benchmark_7", "rfe", "learning_curve", "validation_curve", "kb_seed"):
        text = source.split(f'@query("{name}")')[1].split("\n\n\n")[0]
        assert not re.search(r"folds=|trees=|step=|algorithms=|\"quality\", 2\)", text), name


def test_stump_scores_rows_without_a_value_as_at_the_median(spark):
    rng = np.random.default_rng(3)
    n, k = 300, 3
    x = np.where(rng.random(n) < 0.34, np.nan, rng.integers(0, 20, n).astype(float))
    y = np.where(np.isnan(x), rng.random(n) < 0.5, x > 12).astype(int)
    fold = np.arange(n) % k
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "fold": fold}))
    got = {r["fold"]: r["f1"] for r in landmarks.stump(df, ["x"], "y", k).collect()}
    for g in range(k):
        train = fold != g
        filled = np.where(np.isnan(x), np.nanmedian(x[train]), x)
        best = None
        for cut in np.unique(filled[train])[:-1]:
            sides = [y[train & (filled <= cut)], y[train & (filled > cut)]]
            purity = sum((np.bincount(s, minlength=2) ** 2).sum() / len(s) for s in sides)
            if best is None or round(purity, 6) > best[0]:
                best = round(purity, 6), cut, [int(np.bincount(s, minlength=2).argmax()) for s in sides]
        hat, true = np.where(filled[~train] <= best[1], best[2][0], best[2][1]), y[~train]
        f1 = sum(2 * ((hat == c) & (true == c)).sum() / max(((hat == c).sum() + (true == c).sum()), 1) * (true == c).sum() for c in (0, 1))
        assert got[g] == pytest.approx(f1 / len(true))


def test_three_hundred_classes_train(spark):
    """More classes than any limit used to allow, in the landmarks and in training."""
    rows = spark.range(1800).select(
        F.col("id"), F.floor(F.col("id") / 6).cast("double").alias("x"), F.format_string("c%03d", F.floor(F.col("id") / 6)).alias("y"))
    folded, k = landmarks.with_folds(rows, "id", "y", 3)
    assert k == 3
    stump = landmarks.summarise(landmarks.stump(folded, ["x"], "y", k)).first()
    assert stump["folds"] == 3 and 0 < stump["f1"] < 0.02
    assert landmarks.summarise(landmarks.gaussian_nb(folded, ["x"], "y", k)).first()["f1"] > 0.99
    board = training.train_models(rows, "id", ["x"], "y", algorithms=["DecisionTree"]).board.first()
    assert board["status"] == "ok"
    full = metrics.confusion_matrix(rows.select("y", F.col("y").alias("y_hat")))
    assert full.count() == 300 * 300


def test_validation_curve_prepares_inside_the_folds(df, monkeypatch):
    """Preprocessing is fitted once per fold, on the rows of the other folds alone."""
    seen, fit = [], training.prepared

    def spy(train, features):
        seen.append((train.count(), train.where("fold = 0").count(), train.where("fold = 1").count()))
        return fit(train, features)

    monkeypatch.setattr(training, "prepared", spy)
    training.validation_curve(df, "id", ["strong", "noise"], "y", [2], folds=2, trees=2)
    assert len(seen) == 2 and all(n == max(a, b) and min(a, b) == 0 for n, a, b in seen)


def test_elimination_keeps_half_of_the_raw_columns():
    assert [training.kept_places(n) for n in (1, 3, 8, 50)] == [2, 2, 4, 10]
