"""Projections, filters, predicates and rules."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import EVENT, KB, LINE, LINE_FEATURES, LINE_LONG, NULLS, PRED
from sondage.functions.scalars import confidence_label, minmax_position
from sondage.operators import select
from sondage.operators.profile import column_aggregates
from sondage.plans.quantiles import column_quantiles


@query("split_xy", f"WITH {LINE} SELECT * EXCLUDE (l_returnflag) FROM line")
def _(t):
    return select.split_xy(t.line(), "l_returnflag")[0]


@query("select_by_role", f"WITH {LINE} SELECT * EXCLUDE (l_returnflag, l_linestatus) FROM line")
def _(t):
    return select.select_by_role(t.line(), "numeric")


@query("drop_null_target", f"WITH {NULLS} SELECT * FROM nulls WHERE priority IS NOT NULL")
def _(t):
    return select.drop_null_target(t.null(), "priority")


@query("coerce_numeric_target", """SELECT event_id, TRY_CAST(part AS DOUBLE) AS y FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS part FROM events)
  WHERE TRY_CAST(part AS DOUBLE) IS NOT NULL""")
def _(t):
    raw = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k")).alias("y")
    )
    return select.coerce_numeric_target(raw, "y")


@query("filter_in", """SELECT c_mktsegment, count(*) AS kept FROM customer
  WHERE c_nationkey::VARCHAR IN ('3', '7', '11') GROUP BY ALL""")
def _(t):
    return select.filter_in(t.customer, "c_nationkey", [3, 7, 11]).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("kept")
    )


@query("filter_positive_sort", f"""WITH {NULLS}, c AS (
  SELECT 'o_orderstatus' AS feature, count(*) - count(o_orderstatus) AS missing FROM nulls
  UNION ALL SELECT 'price', count(*) - count(price) FROM nulls
  UNION ALL SELECT 'priority', count(*) - count(priority) FROM nulls)
  SELECT * FROM c WHERE missing > 0 ORDER BY missing DESC""")
def _(t):
    from sondage.operators.profile import missing_by_column

    counts = missing_by_column(t.null().select("o_orderstatus", "price", "priority"))
    return select.filter_positive_sort(counts.select("feature", "missing"), "missing", "feature")


@query("filter_ok_models", """SELECT * FROM (SELECT user_id % 10 AS model, CASE WHEN max(CASE WHEN event_type = 'error'
  THEN value END) > 400 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1) WHERE status = 'ok'""")
def _(t):
    worst = F.max(F.when(F.col("event_type") == "error", F.col("value")))
    runs = t.events.groupBy((F.col("user_id") % 10).alias("model")).agg(
        F.when(worst > 400, "failed").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("n")
    )
    return select.ok_models(runs)


@query("validate_dataset", """SELECT count(*) > 0 AND count(DISTINCT l_returnflag) >= 2 AND count(*) >= 10 AS valid,
  concat_ws('; ', CASE WHEN count(DISTINCT l_returnflag) < 2 THEN 'Target column must have at least 2 unique classes' END,
   CASE WHEN count(*) < 10 THEN 'Dataset too small for reliable analysis (minimum 10 samples)' END) AS issues FROM lineitem""")
def _(t):
    return select.validate_dataset(t.line(), "l_returnflag").withColumn("issues", F.concat_ws("; ", "issues"))


@query("infer_target", """SELECT 'quality' AS target, 2::BIGINT AS classes, count(*) AS n_rows FROM labels
  UNION ALL SELECT 'label', count(DISTINCT label), count(*) FROM embeddings
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders""")
def _(t):
    out = None
    for df in (t.labels.select("doc_id", "quality"), t.embeddings, t.orders):
        target = select.infer_target(df.columns)
        row = df.agg(F.count_distinct(target).alias("classes"), F.count(F.lit(1)).alias("n_rows")).withColumn(
            "target", F.lit(target)
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("infer_task", """SELECT 'l_returnflag' AS target, 'classification' AS task, 0.95::DOUBLE AS confidence,
   count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem
  UNION ALL SELECT 'p_size', CASE WHEN k <= 20 OR s <= 0.1 THEN 'classification' WHEN k > 20 AND s > 0.1 THEN 'regression'
     ELSE 'classification' END, CASE WHEN k <= 20 OR s <= 0.1 THEN 0.8 WHEN k > 20 AND s > 0.1 THEN 0.85 ELSE 0.55 END::DOUBLE, n, k
    FROM (SELECT count(*) AS n, count(DISTINCT p_size) AS k, count(DISTINCT p_size) / count(*)::DOUBLE AS s FROM part)
  UNION ALL SELECT 'o_totalprice', CASE WHEN k > 20 AND s > 0.1 THEN 'regression' ELSE 'classification' END,
     CASE WHEN k > 20 AND s > 0.1 THEN 0.85 ELSE 0.55 END::DOUBLE, n, k
    FROM (SELECT count(*) AS n, count(DISTINCT o_totalprice) AS k, count(DISTINCT o_totalprice) / count(*)::DOUBLE AS s FROM orders)""")
def _(t):
    out = None
    for df, target in ((t.lineitem, "l_returnflag"), (t.part, "p_size"), (t.orders, "o_totalprice")):
        row = select.infer_task(df, target).drop("reason").withColumn("target", F.lit(target))
        out = row if out is None else out.unionByName(row)
    return out


@query("fill_constants", f"""WITH {NULLS} SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(price, 0) AS price,
  coalesce(priority, 'missing') AS priority FROM nulls""")
def _(t):
    return select.fill_constants(t.null())


@query("confidence_label", f"""WITH {PRED} SELECT CASE WHEN score >= .8 THEN 'Very High' WHEN score >= .6 THEN 'High'
  WHEN score >= .4 THEN 'Medium' WHEN score >= .2 THEN 'Low' ELSE 'Very Low' END AS label, count(*) AS n FROM pred GROUP BY 1""")
def _(t):
    return t.pred().groupBy(confidence_label(F.col("score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("explain_rules", f"""WITH {KB}, x AS (SELECT experiment_id, n::DOUBLE AS n, mean_price / mean_acctbal AS imbalance,
   skew_price AS stump, 0.5::DOUBLE AS bayes FROM kb_per)
  SELECT experiment_id, concat_ws(' | ',
   CASE WHEN n < 500 THEN printf('Small dataset (%d samples) - simpler models may generalize better', n::BIGINT)
        WHEN n > 10000 THEN printf('Large dataset (%d samples) - complex ensemble methods can leverage the data', n::BIGINT) END,
   CASE WHEN imbalance > 5 THEN printf('Class imbalance detected (ratio: %.1f) - ensemble methods recommended', imbalance) END,
   CASE WHEN bayes > stump THEN 'Naive Bayes outperforms Decision Stump - suggests simpler decision boundaries'
        ELSE 'Decision Tree outperforms Naive Bayes - suggests non-linear relationships' END,
   'Based on analysis of 5 similar historical datasets') AS explanation FROM x""")
def _(t):
    wide = t.kb().wide(["n_orders", "mean_price", "mean_acctbal", "skew_price"])
    text = select.explanation(
        F.col("n_orders"), F.try_divide("mean_price", "mean_acctbal"), F.col("skew_price"), F.lit(0.5), F.lit(5)
    )
    return wide.select("experiment_id", F.concat_ws(" | ", text).alias("explanation"))


@query("minmax_position", f"""WITH {LINE_LONG}, s AS (SELECT feature, min(value) AS lo, max(value) AS hi,
   quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
  SELECT feature, round((q1 - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100, 3) AS q1_at,
   round((q2 - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100, 3) AS median_at,
   round((q3 - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100, 3) AS q3_at FROM s""")
def _(t):
    line = t.line()
    q = column_quantiles(line, LINE_FEATURES, [0.25, 0.5, 0.75])

    def stats(f):
        c, (q1, q2, q3) = F.col(f), q[f]
        low, high = F.min(c), F.max(c)
        return {
            "q1_at": F.round(minmax_position(F.lit(q1), low, high), 3), "median_at": F.round(minmax_position(F.lit(q2), low, high), 3),
            "q3_at": F.round(minmax_position(F.lit(q3), low, high), 3)}

    return column_aggregates(line, LINE_FEATURES, stats)


@query("missing_map", f"""WITH {NULLS}, f AS (SELECT * FROM nulls ORDER BY o_orderkey LIMIT 200)
  SELECT o_orderkey, 'price' AS "column", (price IS NULL)::INT AS is_missing FROM f
  UNION ALL SELECT o_orderkey, 'priority', (priority IS NULL)::INT FROM f""")
def _(t):
    return select.missing_map(t.null(), "o_orderkey", ["price", "priority"])


@query("summary_document", """SELECT '{"title":"Dataset analysis","dataset_info":{"name":"orders","instances":' || count(*) ||
  ',"features":2},"recommendation":{"algorithm":"' || (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  || '"},"feature_health":{"missing_price":' || sum((o_orderkey % 7 = 0)::INT) || ',"missing_priority":' ||
  sum((o_orderkey % 3 = 0)::INT) || '}}' AS document FROM orders""")
def _(t):
    top = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("c")).orderBy(
        F.col("c").desc(), "o_orderpriority"
    ).limit(1)
    facts = t.null().agg(
        F.count(F.lit(1)).alias("instances"), F.count_if(F.isnull("price")).alias("mp"),
        F.count_if(F.isnull("priority")).alias("mr"),
    )
    # Both sides are a single row.
    return facts.join(F.broadcast(top), F.lit(True)).select(
        F.to_json(
            F.struct(
                F.lit("Dataset analysis").alias("title"),
                F.struct(
                    F.lit("orders").alias("name"), F.col("instances"), F.lit(2).alias("features")
                ).alias("dataset_info"),
                F.struct(F.col("o_orderpriority").alias("algorithm")).alias("recommendation"),
                F.struct(F.col("mp").alias("missing_price"), F.col("mr").alias("missing_priority")).alias("feature_health"),
            )
        ).alias("document")
    )
