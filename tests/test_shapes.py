"""Physical plans: what must reach the scan, and what must not appear."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bindings.tables import LINE_FEATURES, Tables
from sondage.operators import metrics, prepare, profile
from sondage.streaming import oplog


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


def test_only_needed_columns_are_read(tables):
    text = plan(profile.moments(tables.lineitem, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text


def test_filters_reach_the_scan(tables):
    text = plan(profile.class_distribution(tables.orders.where("o_totalprice > 1000"), "o_orderstatus"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text


def test_column_statistics_need_one_exchange_and_no_join(tables):
    text = plan(profile.moments(tables.line(), LINE_FEATURES))
    assert "Join" not in text and (text.count("Exchange SinglePartition") == 0 or text.count("Exchange") <= 2)


def test_correlations_have_no_join(tables):
    text = plan(profile.correlations(tables.line(), LINE_FEATURES))
    assert "Join" not in text and "Cartesian" not in text


def test_confusion_cells_combine_before_the_shuffle(tables):
    text = plan(metrics.per_class(tables.pred()))
    assert "partial_count" in text and "Window" not in text


def test_last_n_is_limited_before_the_shuffle(tables):
    log = tables.events.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("layer"), F.col("value").alias("elapsed"))
    assert plan(oplog.layer_stats(log)).count("WindowGroupLimit") >= 2


NO_CROSS = [
    "profile_columns", "advise", "stratified_split", "kfold_assign", "roc_curve", "rolling_mean", "label_encode",
    "similar_pairs", "flow_links", "kb_upsert", "history_delta",
]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_join_and_no_global_window(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in text
    nested = text.count("BroadcastNestedLoopJoin")
    assert nested == 0, f"{nested} nested loop joins"


def test_splits_use_bucketed_windows(tables):
    text = plan(prepare.kfold_assign(tables.events.select("event_id", "event_type"), "event_id", "event_type"))
    assert "_b" in text and "Exchange SinglePartition" not in text
