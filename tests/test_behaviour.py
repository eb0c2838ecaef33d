"""The published behaviour on small inputs, and edge inputs."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.functions.scalars import confidence_label
from sondage.operators import advise, information, landmarks, metafeatures, metrics, prepare, profile, recommend, select
from sondage.sources.knowledge import SCHEMAS, KnowledgeBase


@pytest.fixture(scope="module")
def classes200(spark):
    """200 rows, ten features, five of them informative."""
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 10))
    x[:, :5] += y[:, None] * 1.5
    frame = pd.DataFrame(x, columns=[f"feature_{i}" for i in range(10)]).assign(target=y, id=np.arange(200))
    return spark.createDataFrame(frame)


def test_meta_features_of_the_200_row_table(classes200):
    row = metafeatures.extract(classes200.drop("id"), "target").first()
    assert (row["l1_n_instances"], row["l1_n_features"], row["l1_n_classes"]) == (200.0, 10.0, 2.0)
    assert row["l1_missing_pct"] == 0.0 and row["l3_class_entropy"] <= 1.0
    assert len(row) == 16


def test_landmarks_lie_between_zero_and_one(classes200):
    rows, k = landmarks.with_folds(classes200, "id", "target", 3)
    features = [f"feature_{i}" for i in range(10)]
    for scores in (landmarks.stump(rows, features, "target", k), landmarks.gaussian_nb(rows, features, "target", k),
                   landmarks.knn(rows, "id", features[:5], "target", k)):
        row = landmarks.summarise(scores).first()
        assert 0.6 < row["f1"] <= 1.0 and row["folds"] == 3


def test_landmark_without_folds_gives_a_reason(classes200):
    one = classes200.where("target = 0")
    assert landmarks.safe_folds(one.limit(1), "target", 5) == 1
    row = landmarks.summarise(landmarks.stump(one, ["feature_0"], "target", 1)).first()
    assert row["f1"] is None and "folds" in row["reason"]


def test_constant_feature_is_flagged(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({
        "constant_feature": np.ones(100), "varying_feature": rng.normal(size=100), "target": rng.integers(0, 2, 100)}))
    issues = advise.advise(df, "target").where("issue_type = 'weak_near_zero_variance'").collect()
    assert [r["feature"] for r in issues] == ["constant_feature"]


def test_skewed_feature_is_flagged(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({
        "normal_feature": rng.normal(size=200), "skewed_feature": rng.exponential(2, 200), "target": rng.integers(0, 2, 200)}))
    rows = advise.advise(df, "target").where("issue_type = 'highly_skewed'").collect()
    assert [(r["feature"], r["recommended_transform"]) for r in rows] == [("skewed_feature", "log1p")]


def test_missing_half_is_high(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i < 50 else None, i % 2) for i in range(100)], "a double, b double, target int")
    rows = advise.advise(df, "target").where("feature = 'b' and issue_type = 'high_missing'").collect()
    assert [r["severity"] for r in rows] == ["high"]
    assert advise.health_summary(advise.advise(df, "target")).first()["status"] == "critical"


def test_no_issues_is_healthy(spark):
    empty = spark.createDataFrame([], "feature string, issue_type string, severity string")
    row = advise.health_summary(empty).first()
    assert (row["status"], row["total_issues"], row["issue_types"]) == ("healthy", 0, {})


def _kb(spark, rows):
    """rows: (hash, {feature: value}, {algorithm: f1}, day)"""
    experiments = [(i, h, h, "d", 100, len(f), datetime(2024, 1, d), datetime(2024, 1, d))
                   for i, (h, f, _, d) in enumerate(rows, 1)]
    features = [(i, k, v) for i, (_, f, _, _) in enumerate(rows, 1) for k, v in f.items()]
    results = [(i, a, s, s, s, s, 5) for i, (_, _, r, _) in enumerate(rows, 1) for a, s in r.items()]
    return KnowledgeBase(
        spark.createDataFrame(experiments, SCHEMAS["experiments"]), spark.createDataFrame(features, SCHEMAS["features"]),
        spark.createDataFrame(results, SCHEMAS["results"]))


def _hashed(kb):
    ids = kb.experiments.select("experiment_id", "dataset_hash")
    return KnowledgeBase(kb.experiments, kb.features.join(ids, "experiment_id"), kb.results.join(ids, "experiment_id"))


def test_upsert_inserts_replaces_and_repeats(spark):
    one = _hashed(_kb(spark, [("h1", {"a": 1.0, "b": 2.0}, {"RandomForest": 0.85}, 1)]))
    kb = KnowledgeBase.empty(spark).upsert(one)
    first = kb.experiments.first()
    assert first["experiment_id"] > 0 and kb.results.count() == 1
    again = kb.upsert(one)
    assert again.experiments.count() == 1 and again.features.count() == 2
    newer = _hashed(_kb(spark, [("h1", {"a": 9.0}, {"KNN": 0.5}, 3), ("h2", {"a": 1.0}, {}, 2)]))
    after = again.upsert(newer)
    assert after.experiments.count() == 2
    kept = after.experiments.where("dataset_hash = 'h1'").first()
    assert kept["experiment_id"] == first["experiment_id"] and kept["created_at"] == first["created_at"]
    assert [(r["feature_name"], r["feature_value"]) for r in after.features.where(F.col("experiment_id") == kept["experiment_id"]).collect()] == [("a", 9.0)]
    assert [r["algorithm_name"] for r in after.results.collect()] == ["KNN"]


def test_upsert_takes_the_latest_of_many_copies(spark):
    many = _kb(spark, [("h", {"a": 1.0}, {"X": 0.1}, 1)])
    copies = many.experiments.withColumn("n_instances", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn(
        "updated_at", F.timestamp_add("SECOND", F.col("n_instances"), F.col("updated_at")))
    out = KnowledgeBase.empty(spark).upsert(KnowledgeBase(copies, _hashed(many).features, _hashed(many).results))
    assert [r["n_instances"] for r in out.experiments.collect()] == [500]


def test_feedback_checks_the_hash(spark):
    kb = _kb(spark, [("h1", {"a": 1.0}, {"KNN": 0.3}, 1)])
    seen = spark.createDataFrame(
        [("h1", "KNN", 0.6, datetime(2024, 2, 1)), ("h1", "KNN", 0.7, datetime(2024, 2, 2)),
         ("no", "KNN", 0.1, datetime(2024, 2, 1))], "dataset_hash string, algorithm_name string, f1_score double, ts timestamp")
    out, rejected = kb.feedback(seen)
    assert [r["f1_score"] for r in out.results.collect()] == [0.7]
    assert [r["dataset_hash"] for r in rejected.collect()] == ["no"]


def test_similar_experiments(spark):
    kb = _kb(spark, [
        ("h1", {"n": 100.0, "f": 10.0, "skew": 0.5}, {"RandomForest": 0.85}, 1),
        ("h2", {"n": 105.0, "f": 12.0, "skew": 0.6}, {"GradientBoosting": 0.87}, 1),
        ("h3", {}, {"KNN": 0.2}, 1)])
    rows = recommend.similar_experiments(kb, {"n": 100.0, "f": 10.0, "skew": 0.5}, 2).collect()
    assert len(rows) == 2 and rows[0]["similarity"] == pytest.approx(1.0)
    every = {r["experiment_id"]: r["similarity"] for r in recommend.similar_experiments(kb, {"n": 1.0}, 9).collect()}
    assert every[3] == 0.0
    votes = recommend.similarity_vote(recommend.similar_experiments(kb, {"n": 100.0, "f": 10.0}, 2), kb.results).first()
    assert votes["algorithm_name"] == "GradientBoosting" and votes["avg_f1"] == pytest.approx(0.87)


def test_cosine_of_equal_orthogonal_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    b = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    got = {(r["query"], r["neighbour"]): r["similarity"] for r in recommend.similar_pairs(q, b, 3, "id", "v").collect()}
    assert got[1, 1] == pytest.approx(1.0) and got[1, 2] == pytest.approx(0.0) and got[1, 3] == pytest.approx(0.0)
    assert all(got[2, i] == pytest.approx(0.0) for i in (1, 2, 3))


def test_ranking_quality(spark):
    df = spark.createDataFrame([(["A", "B", "C"], ["A", "D", "E", "B", "F"], [3.0, 2.0, 3.0, 0.0, 1.0])],
                               "t array<string>, p array<string>, r array<double>")
    assert recommend.precision_at_k(df, "t", "p", 1).first()["precision_at_k"] == 1.0
    assert recommend.precision_at_k(df, "t", "p", 3).first()["precision_at_k"] == pytest.approx(2 / 3)
    assert recommend.precision_at_k(df, "t", "p", 0).first()["precision_at_k"] == 0.0
    assert 0.0 <= recommend.ndcg_at_k(df, "r", 5).first()["ndcg_at_k"] <= 1.0


def test_confidence_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0.9, 0.7, 0.5, 0.3, 0.1)], "s double")
    labels = [r[0] for r in df.select(confidence_label(F.col("s"))).collect()]
    assert labels == ["Very High", "High", "Medium", "Low", "Very Low"]


def test_few_examples_fall_back_to_the_default_ranking(spark):
    kb = _kb(spark, [("h1", {"n": 1.0}, {"KNN": 0.5}, 1)])
    examples = recommend.training_set(kb, ["n"])
    model = recommend.meta_train(examples)
    assert model is None
    rows = recommend.meta_predict(model, examples, "experiment_id").orderBy("rank").collect()
    assert [r["algorithm"] for r in rows] == recommend.DEFAULT_ALGORITHMS and {r["probability"] for r in rows} == {0.2}


def test_validation_messages(spark):
    schema = "a double, y int"
    empty = select.validate_dataset(spark.createDataFrame([], schema), "y").first()
    assert not empty["valid"] and empty["issues"] == ["Dataset is empty"]
    small = select.validate_dataset(spark.createDataFrame([(1.0, 1), (2.0, 1)], schema), "y").first()
    assert len(small["issues"]) == 2
    assert "not found" in select.validate_dataset(spark.createDataFrame([(1.0, 1)], schema), "z").first()["issues"][0]
    good = spark.createDataFrame([(float(i), i % 2) for i in range(10)], schema)
    assert select.validate_dataset(good, "y").first()["valid"]


def test_infer_target_names():
    assert select.infer_target(["a", "Label", "y"]) == "Label"
    assert select.infer_target(["Target", "class"]) == "Target"
    assert select.infer_target(["a", "b"]) == "b"


# -- edges ---------------------------------------------------------------------------------------


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, float("nan"), 5.0), (1.0, None, 2.0, 6.0), (1.0, None, 3.0, 7.0), (1.0, None, 4.0, 100.0), (1.0, None, 5.0, 8.0)],
        "constant double, nothing double, holed double, plain double")
    rows = {r["feature"]: r for r in profile.profile_columns(df, df.columns).collect()}
    assert set(rows) == {"constant", "holed", "plain"}
    assert rows["holed"]["missing"] == 1 and rows["holed"]["median"] == 3.5 and rows["plain"]["outliers"] == 1
    matrix = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, df.columns).collect()}
    assert matrix["constant", "plain"] == 0.0 and matrix["nothing", "plain"] == 0.0 and matrix["plain", "plain"] == 1.0
    hist = profile.histogram(df, ["constant", "plain"]).collect()
    assert sum(r["n"] for r in hist if r["feature"] == "constant") == 5
    assert profile.missing_by_column(df).first()["feature"] == "nothing"


def test_capped_distinct_on_a_skewed_column(spark):
    df = spark.createDataFrame([(0.0,)] * 5000 + [(float(i),) for i in range(1, 31)], "v double")
    assert profile.capped_distinct(df, ["v"], 20)["v"] == (0.0, 30.0, 20)
    assert profile.capped_distinct(df.where("v < 7"), ["v"], 20)["v"] == (0.0, 6.0, 7)


def test_auto_fix_keeps_the_shape_of_clean_data_and_never_touches_the_target(spark):
    rows = [(i, float(i), i % 2) for i in range(10)]
    clean, log = prepare.auto_fix(spark.createDataFrame(rows, "id int, f double, target int"), "target")
    assert clean.count() == 10 and len(clean.columns) == 3 and log.count() == 0
    holes = spark.createDataFrame([(1.0, "a", None), (None, None, 1), (3.0, "a", 0), (3.0, "a", 0)], "f double, c string, target int")
    fixed, log = prepare.auto_fix(holes, "target")
    assert fixed.where("target is null").count() == 1 and fixed.where("f is null or c is null").count() == 0
    assert fixed.count() == 3 and log.count() == 3


def test_string_target_with_null_gets_its_own_code(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "y string")
    coded = {r["y"]: r["y_idx"] for r in prepare.label_encode(df, "y").collect()}
    assert coded == {"a": 0, "b": 1, None: 2}


def test_tied_scores_and_one_class(spark):
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, score double")
    assert metrics.roc_auc(ties).first()["roc_auc"] == 0.5
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    assert metrics.roc_auc(one).first()["roc_auc"] is None
    same = one.withColumn("y_hat", F.col("y"))
    row = metrics.summary(same).first()
    assert (row["accuracy"], row["mcc"], row["kappa"]) == (1.0, 0.0, 0.0)


def test_auc_by_distributed_steps(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"y": rng.integers(0, 2, 2000), "score": np.round(rng.random(2000), 2)})
    df = spark.createDataFrame(frame)
    small, large = metrics.roc_auc(df).first()["roc_auc"], metrics.roc_auc(df, small_rows=0).first()["roc_auc"]
    ranks = frame["score"].rank()
    p = frame["y"].sum()
    want = (ranks[frame["y"] == 1].sum() - p * (p + 1) / 2) / (p * (2000 - p))
    assert small == pytest.approx(want) and large == pytest.approx(want)
    a = metrics.pr_auc(df).first()["pr_auc"]
    assert a == pytest.approx(metrics.pr_auc(df, small_rows=0).first()["pr_auc"])


def test_macro_roc_distributed_equals_small(spark):
    rng = np.random.default_rng(2)
    raw = np.round(rng.random((150, 3)), 1) + 0.1
    rows = [(int(c), (r / r.sum()).round(3).tolist()) for c, r in zip(rng.integers(0, 3, 150), raw)]
    df = spark.createDataFrame(rows, "y int, proba array<double>")
    small = {r["fpr"]: r["tpr"] for r in metrics.roc_macro_average(df).collect()}
    large = {r["fpr"]: r["tpr"] for r in metrics.roc_macro_average(df, small_rows=0).collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)


def test_information_of_a_copy_is_its_entropy(spark):
    df = spark.createDataFrame([(float(i % 4), "abcd"[i % 4], 1.0) for i in range(400)], "x double, y string, c double")
    rows = {r["feature"]: r["mi"] for r in information.mutual_information(df, ["x", "c"], "y").collect()}
    assert rows["x"] == pytest.approx(np.log(4)) and rows["c"] == pytest.approx(0.0, abs=1e-12)


def test_smote_balances_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2).tolist(), int(i >= 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    extra = prepare.smote(df, "id", "v", "y").toPandas()
    assert len(extra) == 40 and set(extra["y"]) == {1}
    low, high = np.array([r[1] for r in rows[60:]]).min(0), np.array([r[1] for r in rows[60:]]).max(0)
    inside = np.stack(extra["v"].to_numpy())
    assert (inside >= low - 1e-9).all() and (inside <= high + 1e-9).all()


def test_split_keeps_class_shares(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = prepare.stratified_split(df, "id", "y").where("is_test").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in rows} == {0: 180, 1: 20}


def test_noise_has_the_asked_spread(spark):
    df = spark.range(4000).withColumn("v", F.col("id") % 100 * 1.0)
    both = df.join(prepare.inject_noise(df, "id", ["v"]).withColumnRenamed("v", "w"), "id")
    std, noise = both.agg(F.stddev("v"), F.stddev(F.col("w") - F.col("v"))).first()
    assert noise / std == pytest.approx(0.5, abs=0.03)


def test_pixel_features_against_numpy():
    from sondage.operators.images import _grey, _measure

    grey = np.add.outer(np.arange(6) * 20, np.arange(5) * 10).astype("float64")
    mean, std, contrast, entropy, _, _, edges = _measure(grey)
    assert mean == grey.mean() and std == grey.std() and contrast == grey.max() and 0 < entropy <= np.log2(30) and edges == 0.0
    bgr = np.dstack([np.full((2, 2), v, dtype=np.uint8) for v in (10, 20, 30)])
    assert (_grey(bgr.tobytes(), 2, 2, 3) == round(10 * 0.114 + 20 * 0.587 + 30 * 0.299)).all()


def test_naive_bayes_with_a_constant_feature(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 2) + i / 1000, i % 2) for i in range(60)], "id int, c double, x double, y int")
    rows, k = landmarks.with_folds(df, "id", "y", 3)
    assert landmarks.summarise(landmarks.gaussian_nb(rows, ["c", "x"], "y", k)).first()["f1"] == 1.0
    only = landmarks.summarise(landmarks.gaussian_nb(rows, ["c"], "y", k)).first()["f1"]
    assert 0.0 < only < 0.6


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "a"), (float("nan"), "b")], "x double, y string")
    missing = {r["feature"]: r["missing"] for r in profile.missing_by_column(df).collect()}
    assert missing == {"x": 3, "y": 0}
    assert profile.missing_pct(df, "y").first()[0] == 75.0
    assert profile.fingerprint(df).first()["missing_total"] == 3


def test_table_without_numbers(spark):
    df = spark.createDataFrame([("a", "u"), ("b", "v"), ("b", "v")], "x string, y string")
    rows = {(r["section"], r["metric"]): r["value"] for r in profile.dataset_profile(df, "y").collect()}
    assert rows["table", "n_rows"] == 3.0 and rows["table", "duplicate_rows"] == 1.0
    assert {s for s, _ in rows} == {"table"}
    clean, _ = prepare.auto_fix(df, "y", aggressive=True)
    assert clean.count() == 2


def test_signal_of_names_that_look_alike(spark):
    rows = [("b_c", "x", 1), ("d", "c", 0), ("b_c", "c", 1), ("d", "x", 0)]
    df = spark.createDataFrame(rows, "a string, a_b string, y int")
    names = [r["feature"] for r in information.feature_signal(df, ["a", "a_b"], "y").collect()]
    assert sorted(names) == ["a_b_c", "a_b_c", "a_b_x", "a_d"]


def test_svm_scores_rows_with_missing_values(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else float(i % 2) + i / 100, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    folds, k = landmarks.with_folds(df, "id", "y", 2)
    scored = []
    monkeypatch.setattr(landmarks, "_fold_scores", lambda p: scored.append(p.count()) or p)
    landmarks.linear_svm(folds, ["x"], "y", k)
    assert scored == [60]


def test_rows_without_a_target_count_as_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None)], "x double, y string")
    assert metafeatures.extract(df, "y").first()["l1_n_instances"] == 3.0
