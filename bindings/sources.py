"""Sources and sinks."""

from pyspark.sql import functions as F

from bindings.profiling import rounded
from bindings.registry import query
from bindings.tables import NULLS
from sondage.operators import profile
from sondage.plans.durable import scratch_path
from sondage.sources import tables

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("scan_csv", f"SELECT {', '.join(COLUMNS)} FROM orders")
def _(t):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.orders.select(*COLUMNS), path)
    return tables.scan_csv(t.spark, path, ORDERS)


@query("scan_csv_inferred", """SELECT 'o_orderkey' AS column, 'numeric' AS role, 0::BIGINT AS missing, count(*) AS n_rows FROM orders
  UNION ALL SELECT 'o_custkey', 'numeric', 0, count(*) FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', 0, count(*) FROM orders
  UNION ALL SELECT 'o_totalprice', 'numeric', 0, count(*) FROM orders UNION ALL SELECT 'o_orderpriority', 'categorical', 0, count(*) FROM orders""")
def _(t):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.orders.select(*COLUMNS), path)
    return tables.preview_schema(tables.scan_csv(t.spark, path)).drop("dtype")


@query("scan_csv_corrupt", """SELECT count(*) AS n_rows, count_if(o_orderstatus <> 'P')::BIGINT AS parsed, count_if(o_orderstatus = 'P')::BIGINT AS corrupt FROM orders""")
def _(t):
    """Lines of one status get a broken number; they are kept and counted, not lost."""
    path = scratch_path(t.spark, "csv")
    key = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(
        F.col("o_orderkey").cast("string"))
    tables.write_csv(t.orders.select(key.alias("o_orderkey"), "o_custkey"), path)
    rows = tables.scan_csv(t.spark, path, "o_orderkey long, o_custkey long", keep_corrupt=True)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("parsed"), F.count("_corrupt").alias("corrupt"))


@query("scan_dir_datasets", """SELECT o_orderstatus AS dataset_id, count(*) AS n_rows, count_if(o_orderkey % 7 = 0)::BIGINT AS missing_total,
  count(DISTINCT o_orderpriority) AS n_classes, 3 AS n_features FROM orders GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "datasets")
    rows = t.null().join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").select(
        "o_orderstatus", "o_orderkey", "o_custkey", "price", "o_orderpriority")
    # A folder per status, whatever statuses there are.
    rows.write.partitionBy("o_orderstatus").csv(path, header=True)
    back = tables.scan_datasets(t.spark, path, "o_orderkey long, o_custkey long, price double, o_orderpriority string")
    back = back.withColumn("dataset_id", F.regexp_replace("dataset_id", "^o_orderstatus=", ""))
    return tables.dataset_summaries(back, "dataset_id", "o_orderpriority")


@query("preview_schema", f"""WITH {NULLS} SELECT 'o_orderkey' AS column, 'bigint' AS dtype, 'numeric' AS role, 0::BIGINT AS missing, count(*) AS n_rows FROM nulls
  UNION ALL SELECT 'o_custkey', 'bigint', 'numeric', 0, count(*) FROM nulls UNION ALL SELECT 'o_orderstatus', 'string', 'categorical', 0, count(*) FROM nulls
  UNION ALL SELECT 'price', 'double', 'numeric', count(*) - count(price), count(*) FROM nulls
  UNION ALL SELECT 'priority', 'string', 'categorical', count(*) - count(priority), count(*) FROM nulls""")
def _(t):
    return tables.preview_schema(t.null())


@query("preview_rows", f"SELECT {', '.join(COLUMNS)} FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return tables.preview_rows(t.orders.select(*COLUMNS), "o_orderkey")


@query("sink_csv", "SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM lineitem GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "metrics")
    tables.write_csv(rounded(profile.class_distribution(t.line(), "l_returnflag"), 6, "share"), path)
    return tables.scan_csv(t.spark, path, "l_returnflag string, n long, share double")


@query("sample_csv", f"SELECT {', '.join(COLUMNS)} FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    path = scratch_path(t.spark, "sample")
    tables.write_csv(tables.sample_rows(t.orders.select(*COLUMNS), "o_orderkey"), path)
    return tables.scan_csv(t.spark, path, ORDERS)


@query("sink_json", """SELECT '{"o_orderstatus":"' || o_orderstatus || '","n":' || count(*) || ',"first":' || min(o_orderkey) || ',"last":' || max(o_orderkey) || '}' AS document
  FROM orders GROUP BY o_orderstatus""")
def _(t):
    path = scratch_path(t.spark, "json")
    facts = t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    tables.write_json(facts, path)
    back = t.spark.read.schema("o_orderstatus string, n long, first long, last long").json(path)
    return tables.as_document(back)
