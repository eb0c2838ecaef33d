"""Knowledge base and recommendation."""

from pyspark.sql import functions as F

from bindings.profiling import rounded
from bindings.registry import query
from bindings.tables import KB, KB_FEATURES
from sondage.operators import recommend
from sondage.plans.durable import scratch_path
from sondage.sources.knowledge import KnowledgeBase

QUERY = {"n_orders": 500.0, "mean_price": 250000.0, "var_price": 2.0e10, "skew_price": 0.1, "mean_acctbal": 4000.0}
WIDE = """wide AS (SELECT experiment_id, n::DOUBLE AS n_orders, mean_price, var_price, skew_price, mean_acctbal FROM kb_per)"""
VECS = f"""vecs AS (SELECT experiment_id, [{', '.join(sorted(KB_FEATURES))}] AS v FROM (SELECT experiment_id, n::DOUBLE AS n_orders,
  mean_price, var_price, skew_price, mean_acctbal FROM kb_per)),
 sims AS (SELECT a.experiment_id AS query, b.experiment_id AS neighbour, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS similarity,
   list_distance(list_transform(a.v, lambda x: x / sqrt(list_dot_product(a.v, a.v))), list_transform(b.v, lambda x: x / sqrt(list_dot_product(b.v, b.v)))) AS dist
   FROM vecs a JOIN vecs b ON a.experiment_id <> b.experiment_id)"""
SCALED = """stats AS (SELECT feature_name, avg(feature_value) AS m, stddev_pop(feature_value) AS s FROM features GROUP BY 1),
 scaled AS (SELECT experiment_id, f.feature_name, (feature_value - m) / s AS z FROM features f JOIN stats USING (feature_name)),
 zvec AS (SELECT experiment_id, list(z ORDER BY feature_name) AS v FROM scaled GROUP BY 1),
 zsim AS (SELECT a.experiment_id AS query, b.experiment_id AS neighbour,
   list_distance(list_transform(a.v, lambda x: x / sqrt(list_dot_product(a.v, a.v))), list_transform(b.v, lambda x: x / sqrt(list_dot_product(b.v, b.v)))) AS dist
   FROM zvec a JOIN zvec b ON a.experiment_id <> b.experiment_id),
 znn AS (SELECT query, neighbour, 1 - dist * dist / 2 AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbour) AS rank FROM zsim)"""
WIN = """win AS (SELECT experiment_id, algorithm_name AS winner FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id
  ORDER BY f1_score DESC, algorithm_name) AS r FROM results) WHERE r = 1)"""


def _scaled(kb):
    """Features scaled over the base, so no single one decides the cosine."""
    stats = kb.features.groupBy("feature_name").agg(F.avg("feature_value").alias("m"), F.stddev_pop("feature_value").alias("s"))
    z = kb.features.join(stats, "feature_name").select(
        "experiment_id", "feature_name", F.try_divide(F.col("feature_value") - F.col("m"), F.col("s")).alias("feature_value"))
    return KnowledgeBase(kb.experiments, z, kb.results)


@query("kb_pivot", f"WITH {KB}, {WIDE} SELECT wide.*, dataset_hash FROM wide JOIN experiments USING (experiment_id)")
def _(t):
    return recommend.pivot(t.kb(), KB_FEATURES)


@query("kb_winners", f"""WITH {KB} SELECT experiment_id, algorithm_name, f1_score, accuracy FROM results r
  WHERE f1_score = (SELECT max(f1_score) FROM results x WHERE x.experiment_id = r.experiment_id)""")
def _(t):
    return recommend.winners(t.kb().results).select("experiment_id", "algorithm_name", "f1_score", "accuracy")


@query("kb_winner_single", f"WITH {KB}, {WIN} SELECT experiment_id, winner AS algorithm_name FROM win")
def _(t):
    return recommend.single_winner(t.kb().results).select("experiment_id", "algorithm_name")


SIMILAR = f"""q AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in QUERY.items())}) v(feature_name, qv)),
 sim AS (SELECT experiment_id, sum(qv * feature_value) / (sqrt(sum(feature_value * feature_value)) * sqrt((SELECT sum(qv * qv) FROM q))) AS similarity
   FROM features JOIN q USING (feature_name) GROUP BY 1),
 top5 AS (SELECT * FROM sim ORDER BY round(similarity, 9) DESC, experiment_id LIMIT 5)"""


@query("similar_experiments", f"WITH {KB}, {SIMILAR} SELECT experiment_id, round(similarity, 8) AS similarity FROM top5")
def _(t):
    return rounded(recommend.similar_experiments(t.kb(), QUERY), 8, "similarity")


@query("similar_pairs", f"WITH {KB}, {SCALED} SELECT query, neighbour, round(similarity, 6) AS similarity, rank::INT AS rank FROM znn WHERE rank <= 3")
def _(t):
    points = recommend.vectors(_scaled(t.kb()), sorted(KB_FEATURES))
    return rounded(recommend.similar_pairs(points, points, 3, "experiment_id", "vec", exclude_self=True), 6, "similarity")


@query("similar_embeddings", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
  d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(a.v, b.v) AS dist FROM u a JOIN u b ON a.vec_id <> b.vec_id)
  SELECT query, neighbour, round(similarity, 6) AS similarity, rank FROM (SELECT query, neighbour, 1 - dist * dist / 2 AS similarity,
    (row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbour))::INT AS rank FROM d) WHERE rank <= 5""")
def _(t):
    e = t.embeddings.select("vec_id", "embedding")
    return rounded(recommend.similar_pairs(e, e, 5, "vec_id", "embedding", exclude_self=True), 6, "similarity")


@query("kb_count", f"WITH {KB} SELECT count(*) AS n_experiments FROM experiments")
def _(t):
    return t.kb().experiments.agg(F.count(F.lit(1)).alias("n_experiments"))


@query("algorithm_stats", f"""WITH {KB} SELECT algorithm_name, count(*) AS n_experiments, round(avg(f1_score), 6) AS avg_f1, round(avg(accuracy), 6) AS avg_accuracy,
  max(f1_score) AS max_f1, min(f1_score) AS min_f1, round(coalesce(stddev_samp(f1_score), 0), 6) AS std_f1 FROM results GROUP BY 1""")
def _(t):
    return rounded(recommend.algorithm_stats(t.kb().results), 6, "avg_f1", "avg_accuracy", "std_f1")


VOTES = "votes AS (SELECT algorithm_name, avg(coalesce(f1_score, 0)) AS avg_f1 FROM results JOIN top5 USING (experiment_id) GROUP BY 1)"


@query("similarity_vote", f"""WITH {KB}, {SIMILAR}, {VOTES} SELECT algorithm_name, round(avg_f1, 6) AS avg_f1,
  (row_number() OVER (ORDER BY avg_f1 DESC, algorithm_name))::INT AS rank FROM votes""")
def _(t):
    kb = t.kb()
    return rounded(recommend.similarity_vote(recommend.similar_experiments(kb, QUERY), kb.results), 6, "avg_f1")


@query("default_ranking", f"""WITH {KB} SELECT experiment_id, i::INT AS rank, ['RandomForest', 'GradientBoosting', 'LogisticRegression', 'SVM', 'KNN'][i] AS algorithm,
  0.2::DOUBLE AS probability FROM experiments, (SELECT unnest(range(1, 6)) AS i)""")
def _(t):
    return recommend.default_ranking(t.kb().experiments, "experiment_id")


@query("combine_rankings", f"""WITH {KB}, {SIMILAR}, {VOTES}, w AS (SELECT r.experiment_id, algorithm_name FROM results r
    WHERE f1_score = (SELECT max(f1_score) FROM results x WHERE x.experiment_id = r.experiment_id)),
  mp AS (SELECT algorithm_name AS algorithm, count(*) / (SELECT count(*) FROM w)::DOUBLE AS probability FROM w GROUP BY 1),
  mr AS (SELECT *, row_number() OVER (ORDER BY probability DESC, algorithm) AS rank FROM mp),
  s AS (SELECT algorithm, probability / rank + coalesce(avg_f1, 0.5) * 0.5 AS score, probability, coalesce(avg_f1, 0) AS f1, rank FROM mr LEFT JOIN votes ON algorithm = algorithm_name)
  SELECT algorithm, round(score, 6) AS combined_score, round(probability, 6) AS rf_probability, round(f1, 6) AS similarity_f1,
   (row_number() OVER (ORDER BY round(score, 9) DESC, rank, algorithm))::INT AS rank FROM s""")
def _(t):
    from pyspark.sql import Window as W

    kb = t.kb()
    won = recommend.winners(kb.results)
    share = won.groupBy(F.col("algorithm_name").alias("algorithm")).agg(
        (F.count(F.lit(1)) / won.agg(F.count(F.lit(1))).scalar()).alias("probability"))
    model = share.withColumn("rank", F.row_number().over(W.orderBy(F.col("probability").desc(), "algorithm")))
    votes = recommend.similarity_vote(recommend.similar_experiments(kb, QUERY), kb.results)
    out = recommend.combine_rankings(model, votes.select(F.col("algorithm_name").alias("algorithm"), "avg_f1"))
    return rounded(out, 6, "combined_score", "rf_probability", "similarity_f1")


@query("meta_training_set", f"WITH {KB}, {WIDE}, {WIN} SELECT wide.*, winner FROM wide JOIN win USING (experiment_id)")
def _(t):
    return recommend.training_set(t.kb(), KB_FEATURES)


@query("meta_evaluate_loo", f"""WITH {KB}, {SCALED}, {WIN}, r AS (SELECT query, rank, a.winner = b.winner AS hit FROM znn JOIN win a ON query = a.experiment_id
    JOIN win b ON neighbour = b.experiment_id WHERE rank <= 3),
  p AS (SELECT query, max((rank = 1 AND hit)::INT) AS p1, max(hit::INT) AS pk, max(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS nd FROM r GROUP BY 1)
  SELECT round(avg(p1), 6) AS precision_at_1, round(avg(pk), 6) AS precision_at_k, round(avg(nd), 6) AS ndcg, count(*) AS n_samples FROM p""")
def _(t):
    out = recommend.leave_one_out(recommend.training_set(_scaled(t.kb()), sorted(KB_FEATURES)))
    return rounded(out, 6, "precision_at_1", "precision_at_k", "ndcg")


def _rankings(t):
    """Per experiment: algorithms by accuracy (truth) and by F1 (prediction), and truth's relevance in predicted order."""
    r = t.kb().results
    ranked = r.groupBy("experiment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("accuracy")).alias("s"), "algorithm_name"))), lambda x: x["algorithm_name"]).alias("truth"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f1_score")).alias("s"), "algorithm_name"))), lambda x: x["algorithm_name"]).alias("predicted"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f1_score")).alias("s"), "algorithm_name", "accuracy"))), lambda x: x["accuracy"]).alias("relevance"),
    )
    return ranked.withColumn("predicted", F.slice("predicted", 1, 3))


LISTS = """lists AS (SELECT experiment_id, list(algorithm_name ORDER BY accuracy DESC, algorithm_name) AS truth,
  list(algorithm_name ORDER BY f1_score DESC, algorithm_name)[1:3] AS predicted, list(accuracy ORDER BY f1_score DESC, algorithm_name) AS relevance FROM results GROUP BY 1)"""


@query("precision_at_k", f"""WITH {KB}, {LISTS} SELECT experiment_id, round(len(list_intersect(truth[1:3], predicted)) / least(3, len(truth))::DOUBLE, 6) AS precision_at_k FROM lists""")
def _(t):
    out = recommend.precision_at_k(_rankings(t), "truth", "predicted", 3)
    return rounded(out.select("experiment_id", "precision_at_k"), 6, "precision_at_k")


@query("ndcg_at_k", f"""WITH {KB}, {LISTS}, x AS (SELECT experiment_id, relevance[1:4] AS a, list_reverse_sort(relevance[1:4]) AS b FROM lists),
  u AS (SELECT experiment_id, unnest(range(len(a))) AS i, a, b FROM x)
  SELECT experiment_id, round(sum((pow(2, a[i + 1]) - 1) / log2(i + 2)) / sum((pow(2, b[i + 1]) - 1) / log2(i + 2)), 6) AS ndcg_at_k FROM u GROUP BY 1""")
def _(t):
    out = recommend.ndcg_at_k(_rankings(t), "relevance", 4)
    return rounded(out.select("experiment_id", "ndcg_at_k"), 6, "ndcg_at_k")


@query("system_stats", f"""WITH {KB} SELECT 'algorithm' AS kind, algorithm_name AS name, round(avg(f1_score), 6) AS value FROM results GROUP BY 2
  UNION ALL SELECT 'system', 'experiments', count(*) FROM experiments UNION ALL SELECT 'system', 'model_trained', 0""")
def _(t):
    return rounded(recommend.system_stats(t.kb(), False), 6, "value")


# -- storage -------------------------------------------------------------------------------------


@query("kb_scan", f"""WITH {KB}, top AS (SELECT * FROM experiments)
  SELECT top.experiment_id, dataset_name, domain, strftime(updated_at, '%Y-%m-%d') AS updated, nf AS n_features, nr AS n_results FROM top
  JOIN (SELECT experiment_id, count(*) AS nf FROM features GROUP BY 1) USING (experiment_id)
  JOIN (SELECT experiment_id, count(*) AS nr FROM results GROUP BY 1) USING (experiment_id)""")
def _(t):
    folder = scratch_path(t.spark, "kb")
    t.kb().save(folder)
    kb = KnowledgeBase.load(t.spark, folder)
    nf = kb.features.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_features"))
    nr = kb.results.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_results"))
    top = kb.experiments.select("experiment_id", "dataset_name", "domain", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
    return top.join(nf, "experiment_id").join(nr, "experiment_id").orderBy(F.desc("updated"), "experiment_id")


def _renewed(t):
    """The experiments of one region again, a day later and with higher scores, plus one new dataset per market segment."""
    kb = t.kb()
    again = kb.experiments.where(F.col("domain") == "ASIA").withColumn("updated_at", F.expr("updated_at + interval 1 day"))
    fresh = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("int").alias("n_instances")).select(
        F.lit(0).cast("long").alias("experiment_id"), F.md5("c_mktsegment").alias("dataset_hash"), F.col("c_mktsegment").alias("dataset_name"),
        F.lit("segment").alias("domain"), "n_instances", F.lit(5).alias("n_features"),
        F.lit("2000-01-01").cast("timestamp").alias("created_at"), F.lit("2000-01-01").cast("timestamp").alias("updated_at"))
    hashed = again.select("experiment_id", "dataset_hash")
    features = kb.features.join(hashed, "experiment_id").withColumn("feature_value", F.col("feature_value") * 2)
    results = kb.results.join(hashed, "experiment_id").withColumn("f1_score", F.col("f1_score") + 0.01)
    return kb, KnowledgeBase(again.unionByName(fresh), features, results)


@query("kb_upsert", f"""WITH {KB} SELECT dataset_name, domain, strftime(created_at, '%Y-%m-%d') AS created, strftime(updated_at + to_days((domain = 'ASIA')::INT), '%Y-%m-%d') AS updated,
   round(total * (1 + (domain = 'ASIA')::INT) / 1000000, 2) AS total, round(best + 0.01::DOUBLE * (domain = 'ASIA')::INT, 6) AS best
  FROM experiments JOIN (SELECT experiment_id, sum(feature_value) AS total FROM features GROUP BY 1) USING (experiment_id)
  JOIN (SELECT experiment_id, max(f1_score) AS best FROM results GROUP BY 1) USING (experiment_id)
  UNION ALL SELECT c_mktsegment, 'segment', '2000-01-01', '2000-01-01', NULL, NULL FROM customer GROUP BY 1""")
def _(t):
    kb, new = _renewed(t)
    out = kb.upsert(new)
    totals = out.features.groupBy("experiment_id").agg(F.round(F.sum("feature_value") / 1000000, 2).alias("total"))
    best = out.results.groupBy("experiment_id").agg(F.round(F.max("f1_score"), 6).alias("best"))
    return out.experiments.join(totals, "experiment_id", "left").join(best, "experiment_id", "left").select(
        "dataset_name", "domain", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), "total", "best")


@query("kb_feedback", f"""WITH {KB}, fb AS (SELECT md5(n_name) AS h, '1-URGENT' AS a, round(avg(s_acctbal) / 20000 + 0.5, 4) AS f1 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
    UNION ALL SELECT md5(r_name), '1-URGENT', 0.5 FROM region)
  SELECT 'result' AS kind, dataset_hash, algorithm_name, coalesce(f1, f1_score) AS f1_score FROM results JOIN experiments USING (experiment_id) LEFT JOIN fb ON h = dataset_hash AND a = algorithm_name
  UNION ALL SELECT 'result', h, a, f1 FROM fb JOIN experiments ON h = dataset_hash WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.experiment_id = experiments.experiment_id AND r.algorithm_name = a)
  UNION ALL SELECT 'reject', h, a, f1 FROM fb WHERE h NOT IN (SELECT dataset_hash FROM experiments)""")
def _(t):
    kb = t.kb()
    observed = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name")
        .agg(F.round(F.avg("s_acctbal") / 20000 + 0.5, 4).alias("f1_score"))
        .select(F.md5("n_name").alias("dataset_hash"), "f1_score")
        .union(t.region.select(F.md5("r_name"), F.lit(0.5)))
        .select("dataset_hash", F.lit("1-URGENT").alias("algorithm_name"), "f1_score", F.lit("2001-01-01").cast("timestamp").alias("ts"))
    )
    out, rejects = kb.feedback(observed)
    rows = out.results.join(out.experiments.select("experiment_id", "dataset_hash"), "experiment_id").select(
        F.lit("result").alias("kind"), "dataset_hash", "algorithm_name", "f1_score")
    return rows.unionByName(rejects.select(F.lit("reject").alias("kind"), "dataset_hash", "algorithm_name", "f1_score"))


@query("kb_export", f"""WITH {KB} SELECT 'experiments' AS name, count(*) AS n, sum(n_instances)::DOUBLE AS total FROM experiments
  UNION ALL SELECT 'features', count(*), round(sum(CASE WHEN feature_name = 'n_orders' THEN feature_value END), 2) FROM features
  UNION ALL SELECT 'results', count(*), round(sum(f1_score), 4) FROM results""")
def _(t):
    folder = scratch_path(t.spark, "kb-csv")
    kb = t.kb()
    kb.export_csv(folder)

    def back(name):
        return t.spark.read.csv(f"{folder}/{name}", header=True, schema=getattr(kb, name).schema)

    one = F.count(F.lit(1)).alias("n")
    parts = [
        back("experiments").agg(one, F.sum("n_instances").cast("double").alias("total")).withColumn("name", F.lit("experiments")),
        back("features").agg(one, F.round(F.sum(F.when(F.col("feature_name") == "n_orders", F.col("feature_value"))), 2).alias("total")).withColumn("name", F.lit("features")),
        back("results").agg(one, F.round(F.sum("f1_score"), 4).alias("total")).withColumn("name", F.lit("results")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
