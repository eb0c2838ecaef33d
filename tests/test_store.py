"""The versioned knowledge-base store."""

from datetime import datetime

import pytest

from sondage.sources.knowledge import SCHEMAS, KnowledgeBase
from sondage.sources.store import KnowledgeStore

DAY = datetime(2024, 1, 1)


@pytest.fixture
def kb(spark):
    n = 40
    return KnowledgeBase(
        spark.createDataFrame([(i, f"h{i}", f"d{i}", "x", 10, 2, DAY, DAY) for i in range(n)], SCHEMAS["experiments"]),
        spark.createDataFrame([(i, f, float(i)) for i in range(n) for f in "ab"] + [(999, "orphan", 1.0)], SCHEMAS["features"]),
        spark.createDataFrame([(i, "KNN", 0.1, None, None, None, 5) for i in range(n)], SCHEMAS["results"]))


def scores(base):
    return {(r["experiment_id"], r["algorithm_name"]): r["f1_score"] for r in base.results.collect()}


def observed(spark, rows):
    return spark.createDataFrame([(h, a, f, DAY) for h, a, f in rows], "dataset_hash string, algorithm_name string, f1_score double, ts timestamp")


def test_a_change_writes_its_own_buckets_only(spark, kb, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "kb"), 16)
    store.save(kb)
    before = scores(store.load())
    assert before == scores(kb) and store.load().features.count() == 81
    rejected = store.feedback(observed(spark, [("h3", "KNN", 0.5), ("h3", "SVM", 0.7), ("none", "SVM", 0.9)]))
    assert [r["dataset_hash"] for r in rejected.collect()] == ["none"]
    assert store.versions() == [0, 1]
    assert scores(store.load()) == before | {(3, "KNN"): 0.5, (3, "SVM"): 0.7}
    assert scores(store.load(0)) == before
    written = list((tmp_path / "kb/data/results/v=1").glob("bucket=*"))
    assert 1 <= len(written) <= 2
    # The same version again, as after a failure.
    store.feedback(observed(spark, [("h3", "KNN", 0.6)]), 0, 1)
    assert store.versions() == [0, 1] and scores(store.load()) == before | {(3, "KNN"): 0.6}


def test_upsert_equals_that_of_the_base(spark, kb, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "kb"), 4)
    store.save(kb)
    new = KnowledgeBase(
        spark.createDataFrame([(0, "h5", "again", "x", 11, 2, DAY, DAY), (0, "new", "n", "x", 1, 1, DAY, DAY)], SCHEMAS["experiments"]),
        spark.createDataFrame([("h5", "a", 50.0), ("new", "a", 1.0)], "dataset_hash string, feature_name string, feature_value double"),
        spark.createDataFrame([("h5", "SVM", 0.9, None, None, None, 5)], "dataset_hash string, " + SCHEMAS["results"].split(", ", 1)[1]))
    store.upsert(new)
    expected, got = kb.upsert(new), store.load()
    for table in SCHEMAS:
        assert sorted(map(str, getattr(got, table).collect())) == sorted(map(str, getattr(expected, table).collect())), table


def test_feedback_into_an_empty_base(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "kb"))
    assert store.load().results.count() == 0
    rejected = store.feedback(observed(spark, [("h", "KNN", 0.5)]))
    assert rejected.count() == 1 and store.load().experiments.count() == 0 and store.versions() == [0]
    store.save(KnowledgeBase.empty(spark), 1)
    assert store.feedback(observed(spark, [("h", "KNN", 0.5)])).count() == 1


def test_vacuum_keeps_what_the_newest_versions_need(spark, kb, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "kb"), 4)
    store.save(kb)
    for i in range(4):
        store.feedback(observed(spark, [("h1", "KNN", i / 10)]))
    last, one_before = scores(store.load()), scores(store.load(3))
    assert store.vacuum(2) > 0
    assert store.versions() == [3, 4] and scores(store.load()) == last and scores(store.load(3)) == one_before
    assert store.vacuum(2) == 0
