"""The test tables, seen as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "disc_price"]


class Tables:
    """Lazy access to one scale's tables and to the views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def line(self) -> DataFrame:
        """Five numeric features, one categorical feature, target ``l_returnflag``."""
        return self.lineitem.select(
            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("disc_price"),
            "l_linestatus", "l_returnflag",
        )

    def event(self) -> DataFrame:
        """Key ``event_id``, features value, hour, k, target ``event_type``."""
        return self.events.select(
            "event_id", "value", F.hour("ts").cast("double").alias("hour"),
            F.get_json_object("props", "$.k").try_cast("double").alias("k"), "event_type",
        )

    def doc(self) -> DataFrame:
        """Labelled documents: key doc_id, features n_chars, lang, source, target quality."""
        return self.documents.select("doc_id", "n_chars", "lang", "source").join(
            self.labels.select("doc_id", "quality"), "doc_id"
        )

    def null(self) -> DataFrame:
        """Orders with about 14 % missing prices and 33 % missing priorities."""
        key = F.col("o_orderkey")
        return self.orders.select(
            "o_orderkey", "o_custkey", "o_orderstatus",
            F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"),
            F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        )

    def dup(self) -> DataFrame:
        """Orders without key, the finished ones given twice."""
        rows = self.orders.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        return rows.unionAll(rows.where(F.col("o_orderstatus") == "F"))

    def const(self) -> DataFrame:
        return self.part.select("p_size", "p_retailprice", F.lit(1.0).alias("constant_feature"), "p_type")

    def pred(self) -> DataFrame:
        """Binary predictions: row_id, model, fold, y, y_hat, score."""
        score = F.round(
            F.least(F.col("value"), F.lit(200.0)) / F.lit(250.0) + (F.col("event_id") % 10) * F.lit(0.01).cast("double"), 4
        )
        return self.events.select(
            F.col("event_id").alias("row_id"),
            (F.col("user_id") % 3).alias("model"),
            (F.col("event_id") % 5).alias("fold"),
            (F.col("event_type") == "error").cast("int").alias("y"),
            (score >= 0.3).cast("int").alias("y_hat"),
            score.alias("score"),
        )

    def pred5(self) -> DataFrame:
        """Five-class predictions with probabilities in ``proba``."""
        raw = F.array(*[F.lit(1) + (F.col("event_id") * (c + 3)) % 97 for c in range(5)])
        total = F.aggregate("raw", F.lit(0).cast("long"), lambda a, x: a + x)
        types = F.array(*[F.lit(e) for e in EVENT_TYPES])
        return self.events.withColumn("raw", raw).select(
            F.col("event_id").alias("row_id"),
            (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("y"),
            (F.array_position("raw", F.array_max("raw")) - 1).cast("int").alias("y_hat"),
            F.transform("raw", lambda x: x.cast("double") / total.cast("double")).alias("proba"),
        )

    def reg(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("row_id"),
            F.col("p_retailprice").alias("actual"),
            (F.lit(925.0) + F.lit(0.025).cast("double") * F.col("p_partkey")).alias("predicted"),
        )

    def kb(self) -> "KnowledgeBase":
        """One experiment per nation, its order statistics as meta-features, order
        priorities as algorithms and the share of finished orders as their score."""
        from sondage.sources.knowledge import KnowledgeBase

        rows = (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        per = rows.groupBy(F.col("n_nationkey").cast("long").alias("experiment_id"), "n_name", "r_name").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderdate").cast("timestamp").alias("created_at"),
            F.max("o_orderdate").cast("timestamp").alias("updated_at"),
            F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
            F.round(F.var_pop("o_totalprice"), 2).alias("var_price"),
            F.round(F.skewness("o_totalprice"), 6).alias("skew_price"),
            F.round(F.avg("c_acctbal"), 4).alias("mean_acctbal"),
        )
        experiments = per.select(
            "experiment_id", F.md5("n_name").alias("dataset_hash"), F.col("n_name").alias("dataset_name"),
            F.col("r_name").alias("domain"), F.col("n").cast("int").alias("n_instances"),
            F.lit(len(KB_FEATURES)).alias("n_features"), "created_at", "updated_at",
        )
        features = per.withColumn("n_orders", F.col("n").cast("double")).unpivot(
            ["experiment_id"], KB_FEATURES, "feature_name", "feature_value"
        )
        finished = F.avg((F.col("o_orderstatus") == "F").cast("double"))
        opened = F.avg((F.col("o_orderstatus") == "O").cast("double"))
        results = rows.groupBy(
            F.col("n_nationkey").cast("long").alias("experiment_id"), F.col("o_orderpriority").alias("algorithm_name")
        ).agg(
            F.round(finished, 6).alias("f1_score"), F.round(opened, 6).alias("accuracy"),
            F.round(finished, 6).alias("precision_score"), F.round(finished, 6).alias("recall_score"),
            F.lit(5).alias("cv_folds"),
        )
        return KnowledgeBase(experiments, features, results)

    def kb_of_nations(self) -> "KnowledgeBase":
        """The same experiments with the standard meta-features of each nation's orders."""
        from sondage.operators import metafeatures
        from sondage.sources.knowledge import KnowledgeBase

        kb = self.kb()
        rows = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("long").alias("experiment_id"), "o_totalprice", "c_acctbal", "o_orderstatus")
        grouped = metafeatures.extract_grouped(rows, "experiment_id", ["o_totalprice", "c_acctbal"], "o_orderstatus")
        return KnowledgeBase(kb.experiments, metafeatures.grouped_long(grouped, "experiment_id"), kb.results)


KB_FEATURES = ["n_orders", "mean_price", "var_price", "skew_price", "mean_acctbal"]

# The same views for the SQL twins.
LINE = """line AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1.0::DOUBLE - l_discount) AS disc_price, l_linestatus, l_returnflag FROM lineitem)"""
LINE_LONG = LINE + """, long AS (
  SELECT feature, value, y FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, l_returnflag AS y FROM line" for c in LINE_FEATURES
) + "))"
EVENT = """event AS (SELECT event_id, value, hour(ts)::DOUBLE AS hour,
  json_extract_string(props, '$.k')::DOUBLE AS k, event_type FROM events)"""
DOC = """doc AS (SELECT d.doc_id, n_chars, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
NULLS = """nulls AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders)"""
DUP = """rows_ AS (SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
 dup AS (SELECT * FROM rows_ UNION ALL SELECT * FROM rows_ WHERE o_orderstatus = 'F')"""
CONST = "const AS (SELECT p_size, p_retailprice, 1.0::DOUBLE AS constant_feature, p_type FROM part)"
PRED = """pred AS (SELECT event_id AS row_id, user_id % 3 AS model, event_id % 5 AS fold,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS y_hat, score
  FROM (SELECT *, round(least(value, 200.0::DOUBLE) / 250.0::DOUBLE + (event_id % 10) * 0.01::DOUBLE, 4) AS score FROM events))"""
REG = """reg AS (SELECT p_partkey AS row_id, p_retailprice AS actual,
  925.0::DOUBLE + 0.025::DOUBLE * p_partkey AS predicted FROM part)"""

KB = """kb_rows AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey
   JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 kb_per AS (SELECT n_nationkey::BIGINT AS experiment_id, n_name, r_name, count(*) AS n,
   min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at,
   round(avg(o_totalprice), 4) AS mean_price, round(var_pop(o_totalprice), 2) AS var_price,
   round(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew_price,
   round(avg(c_acctbal), 4) AS mean_acctbal FROM kb_rows GROUP BY ALL),
 experiments AS (SELECT experiment_id, md5(n_name) AS dataset_hash, n_name AS dataset_name, r_name AS domain,
   n::INT AS n_instances, 5 AS n_features, created_at, updated_at FROM kb_per),
 features AS (SELECT experiment_id, 'n_orders' AS feature_name, n::DOUBLE AS feature_value FROM kb_per
   UNION ALL SELECT experiment_id, 'mean_price', mean_price FROM kb_per
   UNION ALL SELECT experiment_id, 'var_price', var_price FROM kb_per
   UNION ALL SELECT experiment_id, 'skew_price', skew_price FROM kb_per
   UNION ALL SELECT experiment_id, 'mean_acctbal', mean_acctbal FROM kb_per),
 results AS (SELECT n_nationkey::BIGINT AS experiment_id, o_orderpriority AS algorithm_name,
   round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS f1_score, round(avg((o_orderstatus = 'O')::INT::DOUBLE), 6) AS accuracy,
   round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS precision_score, round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS recall_score,
   5 AS cv_folds FROM kb_rows GROUP BY ALL)"""

# The event types in label order.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

PRED5 = f"""raw5 AS (SELECT event_id AS row_id, list_position({EVENT_TYPES}, event_type) - 1 AS y,
   [{', '.join(f"1 + (event_id * {c + 3}) % 97" for c in range(5))}] AS raw FROM events),
 pred5 AS (SELECT row_id, y::INT AS y, (list_position(raw, list_max(raw)) - 1)::INT AS y_hat,
   list_transform(raw, lambda x: x::DOUBLE / list_sum(raw)::DOUBLE) AS proba FROM raw5),
 ovr AS (SELECT c AS class, (y = c)::INT AS y, proba[c + 1] AS score FROM pred5, (SELECT unnest(range(5))::INT AS c))"""
