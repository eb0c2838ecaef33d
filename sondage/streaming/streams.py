"""The operation log as Structured Streaming queries.

Results go to parquet through ``foreachBatch``, one folder per batch id that a
retried batch overwrites, so every row arrives exactly once.  Checkpoints live
below the shared scratch folder.
"""

from __future__ import annotations

import sys
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from sondage.functions.scalars import ratio
from sondage.plans.durable import scratch_path
from sondage.sources.knowledge import KnowledgeBase
from sondage.sources.store import KnowledgeStore
from sondage.streaming.oplog import LATENCIES_KEPT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SALTS = 8
#: Versions of a knowledge base that a stream leaves.
KEPT = 10


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; an explicit schema is required.

    What matches ``pattern`` may be a file or a table's own folder of part files.
    """
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # In braces even a plain name is a pattern: a stream takes a single file only by one.
    return reader.parquet(f"{folder}/{{{pattern}}}" if pattern else folder)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; parquet ones come without."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger
) -> StreamingQuery:
    """Start a query that hands every batch to ``each``; restart with the same ``checkpoint`` to go on."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


#: Sessions that overlap are merged in the tasks that read them, before the shuffle, so a hot key does not go raw to one task.
MERGE_EARLY = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries started inside; a query keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain(stream: DataFrame, label: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Run over everything available, then stop.  Returns the written table and the query."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, MERGE_EARLY):
        query = start(stream, folder_sink(path), scratch_path(spark, f"{label}-state"), mode)
        query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", path).parquet(f"{path}/batch=*").drop("batch"), query


def _bounds(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end")]


def tumbling_stats(log: DataFrame, key: str, size: str) -> DataFrame:
    """Calls, errors, success rate, mean and exact p95 per key and fixed window.

    The p95 is the value at its rank; its state counts the different values of a window and key.
    """
    rows = log.groupBy(F.window("ts", size), key).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"),
        F.avg("elapsed").alias("avg_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed)").alias("p95_ms"))
    rate = ratio(F.col("calls") - F.col("errors"), F.col("calls"), 1.0) * 100
    return rows.select(*_bounds(), key, "calls", "errors", rate.alias("success_rate"), "avg_ms", "p95_ms")


def sliding_mean(log: DataFrame, key: str, size: str, slide: str) -> DataFrame:
    rows = log.groupBy(F.window("ts", size, slide), key).agg(F.avg("elapsed").alias("avg_ms"), F.count(F.lit(1)).alias("n"))
    return rows.select(*_bounds(), key, "avg_ms", "n")


def sessions(log: DataFrame, key: str, gap: str) -> DataFrame:
    rows = log.groupBy(F.session_window("ts", gap).alias("window"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"))
    return rows.select(*_bounds(), key, "n", "elapsed")


def last_n_state(log: DataFrame, key: str, n: int = LATENCIES_KEPT, salts: int = SALTS) -> DataFrame:
    """Keyed state holding the newest n rows by (ts, id), for use in update mode.

    The key is split into ``salts`` parts, each with its own buffer, so a hot key
    is updated by several tasks; :func:`last_n_merge` makes the exact last n of
    the parts.
    """

    def keep(group, frames: Iterator[pd.DataFrame], state):
        seen, kept = state.get if state.exists else (0, [])
        rows = [tuple(x) for x in kept]
        for frame in frames:
            seen += len(frame)
            top = frame.nlargest(n, ["ts_us", "id"])
            rows += list(zip(top["ts_us"].tolist(), top["id"].tolist(), top["elapsed"].tolist()))
        rows = sorted(rows, reverse=True)[:n]
        state.update((seen, rows))
        yield pd.DataFrame({
            key: [group[0]], "salt": [group[1]], "seen": [seen],
            "ts_us": [[r[0] for r in rows]], "id": [[r[1] for r in rows]], "elapsed": [[r[2] for r in rows]],
        })

    parts = log.select(
        key, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.unix_micros("ts").alias("ts_us"), "id", "elapsed")
    kind = log.schema[key].dataType.simpleString()
    return parts.groupBy(key, "salt").applyInPandasWithState(
        keep, f"{key} {kind}, salt int, seen long, ts_us array<long>, id array<long>, elapsed array<double>",
        "seen long, kept array<struct<ts_us:long,id:long,elapsed:double>>", "update", GroupStateTimeout.NoTimeout)


def last_n_merge(buffers: DataFrame, key: str, n: int = LATENCIES_KEPT) -> DataFrame:
    """Newest n rows per key from the latest state of its parts (at most salts x n rows each)."""
    latest = buffers.groupBy(key, "salt").agg(F.max_by(F.struct("ts_us", "id", "elapsed"), "seen").alias("b"))
    rows = latest.select(key, F.inline(F.arrays_zip(
        F.col("b.ts_us").alias("ts_us"), F.col("b.id").alias("id"), F.col("b.elapsed").alias("elapsed"))))
    newest = W.partitionBy(key).orderBy(F.col("ts_us").desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def feedback_into(
    kb: KnowledgeBase, feedback: DataFrame, keys: list[str], root: str | None = None
) -> KnowledgeBase:
    """Stream feedback events into the base, each event once.

    Repeats within the watermark are dropped.  Batch n changes version n of the store below ``root`` into
    version n + 1, writing only the buckets its datasets fall into, so a batch that is run
    again after a failure starts from the same version and replaces its result.  The newest ``KEPT`` versions stay.
    Calling again with the same ``root`` goes on where the last call stopped.
    """
    spark = feedback.sparkSession
    root = root or scratch_path(spark, "kb-stream")
    store = KnowledgeStore(spark, f"{root}/store")
    if not store.versions():
        store.save(kb)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        rejected = store.feedback(batch, batch_id, batch_id + 1)
        rejected.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
        store.vacuum(KEPT)

    query = start(feedback.dropDuplicatesWithinWatermark(keys), upsert, f"{root}/state")
    query.awaitTermination()
    return store.load()


class LateRows(StreamingQueryListener):
    """Adds up, batch by batch, what a query drops behind its watermark; nothing depends on how many batches Spark remembers."""

    def __init__(self):
        self.late: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        name = str(event.progress.runId)
        self.late[name] = self.late.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()


def late_rows(stream: DataFrame, keys: list[str], label: str = "late") -> DataFrame:
    """(kept, late): rows let through and rows behind the watermark, from the query's own progress."""
    listener, streams = LateRows(), stream.sparkSession.streams
    streams.addListener(listener)
    try:
        kept, query = drain(stream.dropDuplicatesWithinWatermark(keys), label)
        run = str(query.runId)
        # Progress arrives in order, the end last.
        if not listener.ended[run].wait(120):
            raise RuntimeError("the end of the stream was not reported")
    finally:
        streams.removeListener(listener)
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(listener.late.get(run, 0)).cast("long"))
