"""Operation log, streams and run history."""

from pyspark.sql import functions as F

from bindings.profiling import rounded
from bindings.registry import query
from bindings.tables import KB
from sondage.plans.durable import scratch_path
from sondage.streaming import oplog, streams

LOG = """log AS (SELECT event_id AS id, ts, event_type AS operation, value AS elapsed, user_id % 10 AS endpoint, event_id % 4 AS layer,
  event_type <> 'error' AS success, event_id % 3 <> 0 AS hit FROM events)"""


def as_log(events):
    return events.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("operation"), F.col("value").alias("elapsed"),
        (F.col("user_id") % 10).alias("endpoint"), (F.col("event_id") % 4).alias("layer"),
        (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 != 0).alias("hit"))


def live(t, delay="1 hour"):
    rows = streams.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    return streams.event_time(as_log(rows), "ts", delay)


def last(key):
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, id DESC) AS r FROM log QUALIFY r <= 100"""


@query("rolling_mean", f"WITH {LOG} SELECT id, operation, round(avg(elapsed) OVER (PARTITION BY operation ORDER BY ts, id ROWS 99 PRECEDING), 8) AS rolling_mean FROM log")
def _(t):
    return rounded(oplog.rolling_mean(as_log(t.events)), 8, "rolling_mean")


@query("rolling_p95", f"""WITH {LOG}, w AS (SELECT id, operation, list_sort(list(elapsed) OVER (PARTITION BY operation ORDER BY ts, id ROWS 99 PRECEDING)) AS v FROM log)
  SELECT id, operation, v[CASE WHEN len(v) < 2 THEN 0 ELSE floor(len(v) * 0.95::DOUBLE)::INT END + 1] AS rolling_p95 FROM w""")
def _(t):
    return oplog.rolling_p95(as_log(t.events))


@query("cache_stats", f"WITH {LOG} SELECT count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses, round(count_if(hit) / count(*)::DOUBLE * 100, 2) AS hit_rate, count(*) AS total FROM log")
def _(t):
    return oplog.cache_stats(as_log(t.events))


@query("layer_stats", f"WITH {LOG} SELECT layer, round(avg(elapsed), 8) AS avg_ms, min(elapsed) AS min_ms, max(elapsed) AS max_ms, count(*) AS samples FROM ({last('layer')}) GROUP BY 1")
def _(t):
    return rounded(oplog.layer_stats(as_log(t.events)), 8, "avg_ms")


P95 = "list(elapsed ORDER BY elapsed)[floor(count(*) * 0.95::DOUBLE)::INT + 1]"
API = f"""api AS (SELECT endpoint, calls, errors, round((calls - errors) / calls::DOUBLE * 100, 2) AS success_rate, round(avg_ms, 8) AS avg_ms, p95_ms
  FROM (SELECT endpoint, count(*) AS calls, count_if(NOT success)::BIGINT AS errors FROM log GROUP BY 1)
  JOIN (SELECT endpoint, avg(elapsed) AS avg_ms, {P95} AS p95_ms FROM ({last('endpoint')}) GROUP BY 1) USING (endpoint))"""


@query("api_stats", f"WITH {LOG}, {API} SELECT * FROM api")
def _(t):
    return rounded(oplog.api_stats(as_log(t.events)), 8, "avg_ms")


@query("recent_logs", f"WITH {LOG} SELECT id, operation, elapsed FROM log ORDER BY ts DESC, id DESC LIMIT 50")
def _(t):
    return oplog.recent_logs(as_log(t.events)).select("id", "operation", "elapsed")


@query("full_report", f"""WITH {LOG}, {API}, lay AS (SELECT layer, round(avg(elapsed), 8) AS avg_ms, min(elapsed) AS min_ms, max(elapsed) AS max_ms, count(*)::DOUBLE AS samples FROM ({last('layer')}) GROUP BY 1),
  op AS (SELECT operation, round(avg(elapsed), 8) AS avg_ms, {P95} AS p95_ms, count(*)::DOUBLE AS samples FROM ({last('operation')}) GROUP BY 1)
  SELECT 'cache' AS section, 'cache' AS name, metric, value FROM (UNPIVOT (SELECT count_if(hit)::DOUBLE AS hits, count_if(NOT hit)::DOUBLE AS misses,
     round(count_if(hit) / count(*)::DOUBLE * 100, 2) AS hit_rate, count(*)::DOUBLE AS total FROM log) ON hits, misses, hit_rate, total INTO NAME metric VALUE value)
  UNION ALL SELECT 'layer', layer::VARCHAR, metric, value FROM (UNPIVOT lay ON avg_ms, min_ms, max_ms, samples INTO NAME metric VALUE value)
  UNION ALL SELECT 'api', endpoint::VARCHAR, metric, value FROM (UNPIVOT (SELECT endpoint, calls::DOUBLE AS calls, errors::DOUBLE AS errors, success_rate, avg_ms, p95_ms FROM api) ON calls, errors, success_rate, avg_ms, p95_ms INTO NAME metric VALUE value)
  UNION ALL SELECT 'operation', operation, metric, value FROM (UNPIVOT op ON avg_ms, p95_ms, samples INTO NAME metric VALUE value)""")
def _(t):
    return rounded(oplog.full_report(as_log(t.events)), 8, "value")


# -- streams -------------------------------------------------------------------------------------

CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query("stream_tumbling", f"""WITH {LOG} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, endpoint, count(*) AS calls, count_if(NOT success)::BIGINT AS errors,
   round((count(*) - count_if(NOT success)) / count(*)::DOUBLE * 100, 3) AS success_rate, round(avg(elapsed), 8) AS avg_ms, quantile_disc(elapsed, 0.95) AS p95_ms
  FROM log GROUP BY 1, 2 HAVING any_value(time_bucket(INTERVAL 1 DAY, ts)) + INTERVAL 1 DAY <= {CLOSED}""")
def _(t):
    out, _ = streams.drain(streams.tumbling_stats(live(t), "endpoint", "1 day"), "tumbling")
    out = out.drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(rounded(out, 3, "success_rate"), 8, "avg_ms")


@query("stream_sliding", f"""WITH {LOG}, s AS (SELECT operation, elapsed, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i::INT) AS start FROM log, (SELECT unnest(range(4)) AS i))
  SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, operation, round(avg(elapsed), 8) AS avg_ms, count(*) AS n FROM s
  WHERE s.start + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, 2""")
def _(t):
    out, _ = streams.drain(streams.sliding_mean(live(t), "operation", "1 day", "6 hours"), "sliding")
    return rounded(out.drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 8, "avg_ms")


@query("stream_session", f"""WITH g AS (SELECT user_id, ts, value, (ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 3) AS elapsed FROM s GROUP BY user_id, sid
  HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def _(t):
    rows = streams.event_time(streams.file_stream(t.spark, t.folder, t.events.schema, "events.parquet"), "ts", "1 hour")
    out, _ = streams.drain(streams.sessions(rows.withColumnRenamed("value", "elapsed"), "user_id", "30 minutes"), "session")
    out = out.drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(out, 3, "elapsed")


@query("stream_last_n", f"WITH {LOG} SELECT operation, id, elapsed, r::INT AS rank FROM ({last('operation')})")
def _(t):
    out, _ = streams.drain(streams.last_n_state(live(t), "operation"), "last-n", "update")
    return streams.last_n_merge(out, "operation").select("operation", "id", "elapsed", "rank")


@query("stream_kb_upsert", f"""WITH {KB}, fb AS (SELECT md5(n_name) AS h, '1-URGENT' AS a, max_by(round(value / 1000, 6), ts) AS f1 FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1)
  SELECT dataset_hash, algorithm_name, coalesce(f1, f1_score) AS f1_score FROM results JOIN experiments USING (experiment_id) LEFT JOIN fb ON h = dataset_hash AND a = algorithm_name
  UNION ALL SELECT h, a, f1 FROM fb JOIN experiments ON h = dataset_hash WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.experiment_id = experiments.experiment_id AND r.algorithm_name = a)""")
def _(t):
    rows = streams.event_time(streams.file_stream(t.spark, t.folder, t.events.schema, "events.parquet"), "ts", "1 hour")
    seen = rows.join(t.nation, F.col("user_id") % 25 == F.col("n_nationkey")).select(
        "event_id", "ts", F.md5("n_name").alias("dataset_hash"), F.lit("1-URGENT").alias("algorithm_name"),
        F.round(F.col("value") / 1000, 6).alias("f1_score"))
    kb = streams.feedback_into(t.kb(), seen.unionAll(seen), ["event_id"])
    return kb.results.join(kb.experiments.select("experiment_id", "dataset_hash"), "experiment_id").select(
        "dataset_hash", "algorithm_name", "f1_score")


@query("late_data", """SELECT count(*) - count_if(late) AS kept, count_if(late)::BIGINT AS late FROM (SELECT coalesce(event_type NOT IN ('click', 'view', 'purchase', 'signup'), true)
  AND ts < (SELECT max(ts) FROM events WHERE event_type IN ('click', 'view')) - INTERVAL 1 HOUR AS late FROM events)""")
def _(t):
    # Three batches of several files: a row is late against the watermark two batches before it.
    folder, files = scratch_path(t.spark, "three-batches"), 4
    kind = F.col("event_type")
    for part in (kind.isin("click", "view"), kind.isin("purchase", "signup"), ~F.coalesce(kind.isin("click", "view", "purchase", "signup"), F.lit(False))):
        t.events.where(part).repartition(files).write.mode("append").parquet(folder)
    rows = streams.file_stream(t.spark, folder, t.events.schema, per_batch=files)
    return streams.late_rows(streams.event_time(rows, "ts", "1 hour"), ["event_id"])


# -- run history ---------------------------------------------------------------------------------

HIST = """hist AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS time, round(avg(o_totalprice), 8) AS score, count(*) AS n_rows,
  max_by(o_orderpriority, o_totalprice) AS model FROM orders GROUP BY 1)"""


def history(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("time")).agg(
        F.round(F.avg("o_totalprice"), 8).alias("score"), F.count(F.lit(1)).alias("n_rows"),
        F.max_by("o_orderpriority", "o_totalprice").alias("model"))


@query("history_track", f"WITH {HIST} SELECT count(*) AS runs, max(score) AS best_score, max_by(model, time) AS latest_model FROM hist")
def _(t):
    return oplog.history_track(history(t))


@query("history_delta", f"""WITH {HIST}, d AS (SELECT left(time, 4) AS dataset, time, score, n_rows FROM hist) SELECT dataset, time, score, n_rows,
  round(score - lag(score) OVER w, 6) AS score_change, n_rows - lag(n_rows) OVER w AS n_rows_change FROM d WINDOW w AS (PARTITION BY dataset ORDER BY time)""")
def _(t):
    rows = history(t).withColumn("dataset", F.substring("time", 1, 4)).drop("model")
    return rounded(oplog.history_delta(rows, ["score", "n_rows"], ["dataset"]), 6, "score_change")


@query("runtime_table", """SELECT event_id, event_type AS model, row_number() OVER (ORDER BY ts, event_id) AS position,
  round(row_number() OVER (ORDER BY ts, event_id) / (count(*) OVER ())::DOUBLE, 6) AS progress FROM events""")
def _(t):
    runs = t.events.select("event_id", F.col("event_type").alias("model"), "ts")
    return rounded(oplog.runtime_table(runs, "ts", "event_id").drop("ts"), 6, "progress")
