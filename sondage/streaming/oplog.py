"""Operation log reports: rolling latencies, per-layer and per-endpoint statistics.

The log is a table ``(ts, id, operation, elapsed, endpoint, layer, success,
hit)``.  "Last n" means the newest n rows by (ts, id).  ``row_number() <= n``
with small n is cut down in every map task before the shuffle, so a hot key
sends at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.scalars import ratio
from sondage.operators.profile import union_all
from sondage.plans.ordering import number_rows, trailing

# Buffer lengths of the reports.
LATENCIES_KEPT = 100
LOGS_KEPT = 1000


def _p95(values: Column) -> Column:
    """Sorted value at 0-based position floor(0.95 n); the only value if n is 1."""
    place = F.floor(F.size(values) * F.lit(0.95)).cast("int")
    return F.get(F.sort_array(values), F.when(F.size(values) < 2, F.lit(0)).otherwise(place))


def rolling_mean(log: DataFrame, key: str = "operation", n: int = LATENCIES_KEPT) -> DataFrame:
    """Per row, the mean of the last n latencies of its key, itself included."""
    rows, window = trailing(log.select("id", "ts", key, "elapsed"), ["ts", "id"], [key], n)
    return rows.select("id", key, F.avg("elapsed").over(window).alias("rolling_mean"), "_context").where(
        ~F.col("_context")).drop("_context")


def rolling_p95(log: DataFrame, key: str = "operation", n: int = LATENCIES_KEPT) -> DataFrame:
    rows, window = trailing(log.select("id", "ts", key, "elapsed"), ["ts", "id"], [key], n)
    values = F.collect_list("elapsed").over(window)
    return rows.select("id", key, _p95(values).alias("rolling_p95"), "_context").where(~F.col("_context")).drop("_context")


def last_n(log: DataFrame, key: str, n: int = LATENCIES_KEPT) -> DataFrame:
    newest = W.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    return log.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def cache_stats(log: DataFrame) -> DataFrame:
    hits = F.count_if("hit")
    return log.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("hit").alias("total")).select(
        "hits", "misses", F.round(ratio(F.col("hits"), F.col("total")) * 100, 2).alias("hit_rate"), "total")


def layer_stats(log: DataFrame, key: str = "layer") -> DataFrame:
    return last_n(log.select(key, "ts", "id", "elapsed"), key).groupBy(key).agg(
        F.avg("elapsed").alias("avg_ms"), F.min("elapsed").alias("min_ms"), F.max("elapsed").alias("max_ms"),
        F.count(F.lit(1)).alias("samples"))


def latest_latency(log: DataFrame, key: str) -> DataFrame:
    """Mean, p95 and sample count of the last n latencies per key (lists of at most n)."""
    return last_n(log.select(key, "ts", "id", "elapsed"), key).groupBy(key).agg(
        F.avg("elapsed").alias("avg_ms"), _p95(F.collect_list("elapsed")).alias("p95_ms"),
        F.count(F.lit(1)).alias("samples"))


def api_stats(log: DataFrame, key: str = "endpoint") -> DataFrame:
    totals = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"))
    rate = F.round(ratio(F.col("calls") - F.col("errors"), F.col("calls"), 1.0) * 100, 2)
    return totals.withColumn("success_rate", rate).join(latest_latency(log, key).drop("samples"), key)


def recent_logs(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(min(n, LOGS_KEPT))


def full_report(log: DataFrame) -> DataFrame:
    """Everything as (section, name, metric, value) rows."""

    def rows(frame, section, name, metrics):
        return frame.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))

    return union_all([
        rows(cache_stats(log), "cache", F.lit("cache"), ["hits", "misses", "hit_rate", "total"]),
        rows(layer_stats(log), "layer", F.col("layer"), ["avg_ms", "min_ms", "max_ms", "samples"]),
        rows(api_stats(log), "api", F.col("endpoint"), ["calls", "errors", "success_rate", "avg_ms", "p95_ms"]),
        rows(latest_latency(log, "operation"), "operation", F.col("operation"), ["avg_ms", "p95_ms", "samples"]),
    ])


# -- run history -----------------------------------------------------------------------------


def history_track(history: DataFrame, run: DataFrame | None = None) -> DataFrame:
    """Append a run, then count, best score and latest model."""
    rows = history if run is None else history.unionByName(run)
    return rows.agg(
        F.count(F.lit(1)).alias("runs"), F.max("score").alias("best_score"),
        F.max_by("model", F.struct("time", "model")).alias("latest_model"))


def history_delta(history: DataFrame, metrics: list[str], within: list[str], time: str = "time") -> DataFrame:
    """Each version's metrics and their change since the version before (null for the first)."""
    rows, window = trailing(history, [time], within, 2)
    before = {m: F.first(m).over(window) for m in metrics}
    second = F.count(F.lit(1)).over(window) == 2
    out = rows.select(
        *within, time, *metrics, "_context",
        *[F.when(second, F.col(m) - before[m]).alias(f"{m}_change") for m in metrics])
    return out.where(~F.col("_context")).drop("_context")


def runtime_table(runs: DataFrame, finished: str, key: str) -> DataFrame:
    """Runs in the order they finished, with the share done after each."""
    total = runs.agg(F.count(F.lit(1))).scalar()
    numbered = number_rows(runs, [finished, key], name="position")
    return numbered.withColumn("progress", ratio(F.col("position"), total))
