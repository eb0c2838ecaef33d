"""Streams against their batch twins, restarts and repeated batches."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.sources.knowledge import SCHEMAS, KnowledgeBase
from sondage.streaming import oplog, streams

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """900 rows in three files, in time order; one operation has most of them."""
    folder = str(tmp_path_factory.mktemp("log"))
    rows = [
        (i, START + timedelta(minutes=7 * i), "hot" if i % 3 else f"op{i % 4}", float(i * 37 % 101), i % 5 != 0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, operation string, elapsed double, success boolean")
    for part in range(3):
        df.where((F.col("id") >= part * 300) & (F.col("id") < (part + 1) * 300)).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def live(spark, log, delay="1 hour"):
    df, folder = log
    return streams.event_time(streams.file_stream(spark, folder, df.schema, per_batch=1), "ts", delay)


def test_closed_windows_equal_the_batch(spark, log):
    out, query = streams.drain(streams.tumbling_stats(live(spark, log), "operation", "6 hours"), "w")
    got = out.toPandas().sort_values(["start", "operation"]).reset_index(drop=True)
    assert len(query.recentProgress) >= 3
    want = streams.tumbling_stats(log[0], "operation", "6 hours").where(
        F.col("end") <= F.lit(START + timedelta(minutes=7 * 899 - 60))).toPandas().sort_values(["start", "operation"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_last_n_state_equals_last_n(spark, log):
    out, _ = streams.drain(streams.last_n_state(live(spark, log), "operation", n=20, salts=4), "n", "update")
    got = {(r["operation"], r["id"]) for r in streams.last_n_merge(out, "operation", 20).collect()}
    want = {(r["operation"], r["id"]) for r in oplog.last_n(log[0], "operation", 20).collect()}
    assert got == want


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    sink = streams.folder_sink(str(tmp_path))
    for _ in range(2):
        sink(spark.range(5), 0)
    sink(spark.range(3), 1)
    assert spark.read.parquet(f"{tmp_path}/batch=*").count() == 8


def test_feedback_stream_goes_on_after_a_restart(spark, tmp_path):
    day = START
    kb = KnowledgeBase(
        spark.createDataFrame([(1, "h", "d", "x", 10, 2, day, day)], SCHEMAS["experiments"]),
        spark.createDataFrame([(1, "a", 1.0)], SCHEMAS["features"]),
        spark.createDataFrame([(1, "KNN", 0.1, None, None, None, 5)], SCHEMAS["results"]))
    schema = "event_id long, ts timestamp, dataset_hash string, algorithm_name string, f1_score double"
    source, root = str(tmp_path / "in"), str(tmp_path / "kb")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        seen = streams.event_time(spark.readStream.schema(schema).parquet(source), "ts", "1 hour")
        out = streams.feedback_into(kb, seen, ["event_id"], root)
        return {r["algorithm_name"]: r["f1_score"] for r in out.results.collect()}

    add([(1, day, "h", "KNN", 0.5), (1, day, "h", "KNN", 0.5), (2, day, "unknown", "KNN", 0.9)])
    assert run() == {"KNN": 0.5}
    assert run() == {"KNN": 0.5}
    add([(3, day + timedelta(minutes=5), "h", "SVM", 0.7)])
    assert run() == {"KNN": 0.5, "SVM": 0.7}
    assert {r["dataset_hash"] for r in spark.read.parquet(f"{root}/rejects/batch=*").collect()} == {"unknown"}


def test_late_rows_are_counted(spark, log, tmp_path):
    df, _ = log
    folder = str(tmp_path)
    for part in ("id >= 600", "id >= 300 and id < 600", "id < 300"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
    rows = streams.event_time(streams.file_stream(spark, folder, df.schema, per_batch=1), "ts", "1 hour")
    got = streams.late_rows(rows, ["id"]).first()
    assert got["kept"] + got["late"] == 900 and got["late"] == 300


def test_history(spark):
    runs = spark.createDataFrame([("d", "2024-01-01", 0.5, "A"), ("d", "2024-01-02", 0.7, "B"), ("e", "2024-01-03", 0.6, "C")],
                                 "dataset string, time string, score double, model string")
    assert tuple(oplog.history_track(runs).first()) == (3, 0.7, "C")
    rows = {(r["dataset"], r["time"]): r["score_change"] for r in oplog.history_delta(runs.drop("model"), ["score"], ["dataset"]).collect()}
    assert rows["d", "2024-01-01"] is None and rows["d", "2024-01-02"] == pytest.approx(0.2) and rows["e", "2024-01-03"] is None


def test_late_rows_of_more_batches_than_spark_remembers(spark, tmp_path):
    """Fifteen batches while only three progress reports are kept; two of the batches hold late rows."""
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        for batch in range(15):
            early = batch in (4, 9)
            rows = [(batch * 10 + i, f"2024-01-{1 if early else 2 + batch:02} 00:00:0{i}") for i in range(6)]
            df = spark.createDataFrame(rows, "id long, at string").select("id", F.to_timestamp("at").alias("ts"))
            # Two files a batch.
            df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.event_time(streams.file_stream(spark, str(tmp_path / "in"), df.schema, per_batch=2), "ts", "1 hour")
        assert tuple(streams.late_rows(stream, ["id"], "late-test").first()) == (78, 12)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_p95_of_a_large_window_is_exact(spark, tmp_path):
    """More than ten thousand different values in one window."""
    n = 30_001
    df = spark.range(n).select(
        F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("ts"), F.lit("k").alias("key"), F.lit(True).alias("success"),
        ((F.col("id") * 7919) % n).cast("double").alias("elapsed"))
    end = df.limit(1).withColumn("ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    df.write.mode("append").parquet(str(tmp_path / "in"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_time(streams.file_stream(spark, str(tmp_path / "in"), df.schema, per_batch=64), "ts", "1 hour")
    out, _ = streams.drain(streams.tumbling_stats(stream, "key", "1 day"), "p95-test")
    row = out.orderBy("start").first()
    assert (row["calls"], row["p95_ms"]) == (n, float(-(-n * 95 // 100) - 1))


def test_sessions_merge_before_the_shuffle(spark, tmp_path):
    """One user with most of the rows: what is shuffled are sessions, not rows."""
    df = spark.range(4000).select(
        F.timestamp_seconds(F.lit(1704100000) + F.col("id")).alias("ts"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(1).alias("user"),
        F.lit(1.0).alias("elapsed"))
    end = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1705100000)))
    for part in (df, end):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_time(streams.file_stream(spark, str(tmp_path / "in"), df.schema, per_batch=1), "ts", "1 hour")
    out, query = streams.drain(streams.sessions(stream, "user", "30 minutes"), "merge-test")
    assert {r["user"]: r["n"] for r in out.collect()} == {r["user"]: r["n"] for r in df.groupBy("user").agg(F.count("*").alias("n")).collect()}
    plan = query._jsq.explainInternal(False)
    first = plan.rindex("Exchange")
    assert "MergingSessions" in plan[first:] or "UpdatingSessions" in plan[first:], plan
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "false"


def test_a_table_is_streamed_from_one_file_or_from_part_files(spark, tmp_path):
    df = spark.range(20)
    df.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    df.toPandas().to_parquet(tmp_path / "single.parquet")
    for name in ("parts.parquet", "single.parquet"):
        out, _ = streams.drain(streams.file_stream(spark, str(tmp_path), df.schema, name), "named")
        assert sorted(r.id for r in out.collect()) == list(range(20)), name
