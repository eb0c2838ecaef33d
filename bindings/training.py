"""Landmarks, training, benchmarking and explanation."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindings.knowledge import _scaled
from bindings.profiling import EVENT_FEATURES, rounded
from bindings.registry import query
from bindings.tables import DOC, EVENT, KB_FEATURES, PRED
from sondage.operators import advise, landmarks, metafeatures, metrics, recommend, training, treeshap
from sondage.plans.durable import scratch_path

FEATURES = ["n_chars", "lang", "source"]


def fold_sql(source, key, y, k):
    return f"row_number() OVER (PARTITION BY {y} ORDER BY md5('42-' || {key}), {key}) - 1) % {k} AS fold"


WEIGHTED_F1 = """per AS (SELECT p.fold, c, count_if(y = c)::DOUBLE AS s, count_if(y_hat = c)::DOUBLE AS h, count_if(y = c AND y_hat = c)::DOUBLE AS tp
   FROM pr p, (SELECT DISTINCT y AS c FROM pr) GROUP BY ALL),
 f1s AS (SELECT fold, sum(s * CASE WHEN s + h > 0 THEN 2 * tp / (s + h) ELSE 0 END) / sum(s) AS f1 FROM per GROUP BY 1)"""


@query("landmark_stump", f"""WITH {DOC}, e AS (SELECT *, ({fold_sql('doc', 'doc_id', 'quality', 3)} FROM doc),
  long AS (SELECT doc_id, quality AS y, fold, 'n_chars' AS feature, n_chars::DOUBLE AS value FROM e UNION ALL SELECT doc_id, quality, fold, 'source_len', length(source)::DOUBLE FROM e),
  cuts AS (SELECT DISTINCT feature, value AS cut FROM long), g AS (SELECT unnest(range(3)) AS g),
  sc AS (SELECT g.g AS fold, l.feature, cut, count_if(value <= cut AND y = 0)::DOUBLE AS l0, count_if(value <= cut AND y = 1)::DOUBLE AS l1,
     count_if(value > cut AND y = 0)::DOUBLE AS r0, count_if(value > cut AND y = 1)::DOUBLE AS r1 FROM cuts JOIN long l USING (feature), g WHERE l.fold <> g.g GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1), 6) DESC, feature, cut) AS rk
     FROM sc WHERE l0 + l1 > 0 AND r0 + r1 > 0),
  pr AS (SELECT l.fold, y, CASE WHEN value <= cut THEN (l1 > l0)::INT ELSE (r1 > r0)::INT END AS y_hat FROM long l JOIN best b ON l.fold = b.fold AND l.feature = b.feature AND rk = 1),
  {WEIGHTED_F1} SELECT round(avg(f1), 6) AS f1, count(*) AS folds FROM f1s""")
def _(t):
    df = t.doc().withColumn("source_len", F.length("source").cast("double"))
    rows, k = landmarks.with_folds(df, "doc_id", "quality", 3)
    out = landmarks.summarise(landmarks.stump(rows, ["n_chars", "source_len"], "quality", k))
    return rounded(out.drop("reason"), 6, "f1")


@query("landmark_nb", f"""WITH {EVENT}, e AS (SELECT *, ({fold_sql('event', 'event_id', 'event_type', 3)} FROM event),
  v AS (SELECT greatest(var_pop(value), var_pop(hour), var_pop(k)) * 1e-9 AS eps FROM event), g AS (SELECT unnest(range(3)) AS g),
  tot AS (SELECT g.g, count(*) AS n FROM e, g WHERE fold <> g.g GROUP BY 1),
  p AS (SELECT g.g, event_type AS c, count(*) / any_value(tot.n)::DOUBLE AS prior, avg(value) AS m1, var_pop(value) + any_value(eps) AS s1,
    avg(hour) AS m2, var_pop(hour) + any_value(eps) AS s2, avg(k) AS m3, var_pop(k) + any_value(eps) AS s3 FROM e, g, v, tot WHERE fold <> g.g AND tot.g = g.g GROUP BY g.g, event_type),
  l AS (SELECT event_id, fold, event_type AS y, c, ln(prior) - 0.5 * ln(2 * pi() * s1) - pow(value - m1, 2) / (2 * s1) - 0.5 * ln(2 * pi() * s2) - pow(hour - m2, 2) / (2 * s2)
    - 0.5 * ln(2 * pi() * s3) - pow(k - m3, 2) / (2 * s3) AS ll FROM e JOIN p ON e.fold = p.g),
  pr AS (SELECT fold, any_value(y) AS y, max_by(c, ll) AS y_hat FROM l GROUP BY event_id, fold), {WEIGHTED_F1}
  SELECT round(avg(f1), 5) AS f1, count(*) AS folds FROM f1s""")
def _(t):
    rows, k = landmarks.with_folds(t.event(), "event_id", "event_type", 3)
    out = landmarks.summarise(landmarks.gaussian_nb(rows, EVENT_FEATURES, "event_type", k))
    return rounded(out.drop("reason"), 5, "f1")


@query("landmark_knn", f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, ({fold_sql('embeddings', 'vec_id', 'label', 2)} FROM embeddings),
  u AS (SELECT vec_id, label, fold, unnest(range(1, 65)) AS d, unnest(v) AS x FROM e), g AS (SELECT unnest(range(2)) AS g),
  st AS (SELECT g.g, d, avg(x) AS m, stddev_pop(x) AS s FROM u, g WHERE fold <> g.g GROUP BY ALL),
  z AS (SELECT g, vec_id, label, fold, list((x - m) / s ORDER BY u.d) AS v FROM u JOIN st ON u.d = st.d GROUP BY ALL),
  nn AS (SELECT a.vec_id, a.fold, a.label AS y, b.label AS y_hat, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS r
    FROM z a JOIN z b ON a.g = b.g AND a.fold = a.g AND b.fold <> b.g),
  pr AS (SELECT * FROM nn WHERE r = 1), {WEIGHTED_F1} SELECT round(avg(f1), 6) AS f1, count(*) AS folds FROM f1s""")
def _(t):
    rows, k = landmarks.with_folds(t.embeddings, "vec_id", "label", 2)
    out = landmarks.summarise(landmarks.knn(rows, "vec_id", "embedding", "label", k))
    return rounded(out.drop("reason"), 6, "f1")


def _wide_doc(t):
    return t.doc().withColumn("source_len", F.length("source").cast("double")).withColumn("n_chars", F.col("n_chars").cast("double"))


@query("landmark_svm")
def _(t):
    rows, k = landmarks.with_folds(_wide_doc(t), "doc_id", "quality", 3)
    return landmarks.summarise(landmarks.linear_svm(rows, ["n_chars", "source_len"], "quality", k))


@query("landmark_gap")
def _(t):
    rows, k = landmarks.with_folds(_wide_doc(t), "doc_id", "quality", 3)
    f = ["n_chars", "source_len"]
    return landmarks.landmark_gap(landmarks.linear_svm(rows, f, "quality", k), landmarks.stump(rows, f, "quality", k))


@query("benchmark_5")
def _(t):
    p = training.cross_validate(t.doc(), "doc_id", FEATURES, "quality", training.BENCHMARK_5)
    return training.benchmark(p)


@query("benchmark_7")
def _(t):
    p = training.cross_validate(t.doc(), "doc_id", FEATURES, "quality", training.BENCHMARK_7)
    return training.benchmark(p, with_auc=True)


@query("automl_train")
def _(t):
    return training.train_models(t.doc(), "doc_id", FEATURES, "quality").board


@query("automl_train_regression")
def _(t):
    rows = t.part.select("p_partkey", "p_retailprice", "p_size", "p_brand", "p_type")
    return training.train_models(rows, "p_partkey", ["p_size", "p_brand", "p_type"], "p_retailprice", "regression").board


@query("model_catalog", f"""WITH {DOC} SELECT n_rows, task, model FROM (SELECT count(*) AS n_rows FROM doc),
  (VALUES ('classification', 'LogisticRegression'), ('classification', 'RandomForest'), ('classification', 'GradientBoosting'), ('classification', 'LinearSVM'), ('classification', 'DecisionTree'), ('classification', 'NaiveBayes'), ('classification', 'NeuralNetwork'), ('regression', 'LinearRegression'), ('regression', 'RandomForest'), ('regression', 'GradientBoosting'), ('regression', 'DecisionTree'), ('regression', 'GeneralizedLinear')) v(task, model)""")
def _(t):
    counts = t.doc().agg(F.count_distinct("quality").alias("k"), F.count(F.lit(1)).alias("n_rows"))
    k, _ = counts.first()
    names = [("classification", n) for n in training.model_catalog("classification", k, 8)]
    names += [("regression", n) for n in training.model_catalog("regression")]
    rows = F.array(*[F.struct(F.lit(a).alias("task"), F.lit(n).alias("model")) for a, n in names])
    return counts.select("n_rows", F.inline(rows))


@query("notebook_variants")
def _(t):
    return training.notebook_variants(t.doc(), "doc_id", FEATURES, "quality")


@query("rfe")
def _(t):
    rows, _ = training.labelled(t.doc(), "quality")
    model, cast = training.prepared(rows, FEATURES)
    vectors = model.transform(cast(rows)).select("label", "features")
    names = training.vector_names(model, ["n_chars"], ["lang", "source"])
    places = training.recursive_elimination(vectors, len(names), training.kept_places(len(FEATURES)))
    return t.spark.createDataFrame([(i + 1, names[p]) for i, p in enumerate(places)], "place int, feature string")


@query("learning_curve")
def _(t):
    return training.learning_curve(
        t.doc(), "doc_id", FEATURES, "quality", LogisticRegression(maxIter=500), [0.3, 0.475, 0.65, 0.825, 1.0])


@query("validation_curve")
def _(t):
    return training.validation_curve(t.doc(), "doc_id", FEATURES, "quality")


def _fitted(t):
    return training.train_models(t.doc(), "doc_id", FEATURES, "quality", algorithms=["LogisticRegression", "RandomForest"])


@query("feature_importance")
def _(t):
    run = _fitted(t)
    return training.feature_importance(run.models["RandomForest"], run.names, t.spark, 15)


@query("attribution_linear", """WITH m AS (SELECT avg(p_size) AS a, avg(p_partkey) AS b FROM part)
  SELECT 'p_size' AS feature, round(avg(abs(2.5 * (p_size - a))), 5) AS mean_abs FROM part, m
  UNION ALL SELECT 'p_partkey', round(avg(abs(-0.01 * (p_partkey - b))), 5) FROM part, m""")
def _(t):
    return rounded(training.linear_attribution(t.part, {"p_size": 2.5, "p_partkey": -0.01}), 5, "mean_abs")


@query("attribution_global")
def _(t):
    """Mean Shapley value of each feature in the forest's probability of good quality."""
    run = _fitted(t)
    return treeshap.attribution_global(run.models["RandomForest"], run.test, "doc_id", run.names)


@query("attribution_sums", f"WITH {DOC} SELECT count(*)::BIGINT AS n, 0::BIGINT AS differing FROM doc")
def _(t):
    """Rows whose Shapley values do not sum to the forest's prediction less its base, among all."""
    run = _fitted(t)
    model, rows = run.models["RandomForest"], run.train.unionByName(run.test)
    parts = treeshap.tree_attribution(model, rows, "doc_id", run.names).groupBy("doc_id").agg((F.sum("value") + F.first("base")).alias("sum"))
    scored = model.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("p"))
    return parts.join(scored, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("sum") - F.col("p")) > 1e-6).alias("differing"))


@query("attribution_permutation")
def _(t):
    run = _fitted(t)
    return training.permutation_importance(run.models["RandomForest"], run.test, "doc_id", run.names, len(run.classes))


@query("attribution_local")
def _(t):
    run = _fitted(t)
    row = run.test.orderBy("doc_id").select(vector_to_array("features")).first()[0]
    return training.local_attribution(run.models["RandomForest"], row, [1.0] * len(row), run.names, t.spark)


@query("model_save_load", f"WITH {DOC} SELECT count(*) AS n, 0::BIGINT AS differing FROM doc")
def _(t):
    """Every row scored by the model before saving and after loading."""
    run = _fitted(t)
    folder = scratch_path(t.spark, "model")
    model = run.pipeline("LogisticRegression")
    training.save_model(model, folder)
    rows = t.doc().withColumn("n_chars", F.col("n_chars").cast("double"))
    return _differing(training.batch_score(model, rows, "doc_id"), training.batch_score(training.load_model(folder), rows, "doc_id"))


def _differing(a, b):
    both = a.withColumnRenamed("prediction", "p").join(b, "doc_id", "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p").eqNullSafe(F.col("prediction"))).alias("differing"))


@query("batch_score")
def _(t):
    run = _fitted(t)
    rows = t.doc().withColumn("n_chars", F.col("n_chars").cast("double"))
    return training.batch_score(run.pipeline("RandomForest"), rows, "doc_id").groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("stream_score", "SELECT count(*) AS n, 0::BIGINT AS differing FROM documents")
def _(t):
    """Every document scored by the stream and by the batch."""
    from sondage.streaming import streams

    rows = streams.file_stream(t.spark, t.folder, t.documents.schema, "documents.parquet")
    model = _fitted(t).pipeline("LogisticRegression")

    def score(df):
        return training.batch_score(model, df.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source"), "doc_id")

    return _differing(score(t.documents), streams.drain(score(rows), "scored")[0])


# -- meta-model and whole paths ------------------------------------------------------------------


@query("meta_train")
def _(t):
    examples = recommend.training_set(t.kb(), KB_FEATURES)
    model = recommend.meta_train(examples)
    return training.feature_importance(model.stages[-1], model.stages[1].getInputCols(), t.spark)


@query("meta_predict")
def _(t):
    kb = t.kb()
    model = recommend.meta_train(recommend.training_set(kb, KB_FEATURES))
    return recommend.meta_predict(model, kb.wide(KB_FEATURES), "experiment_id")


@query("recommend")
def _(t):
    return recommend.recommend(t.null().drop("o_orderkey"), "o_orderstatus", t.kb_of_nations())["ranking"]


@query("recommend_report")
def _(t):
    """The best algorithm with its reasons, from all four layers of features."""
    found = recommend.recommend(t.null().drop("o_custkey"), "o_orderstatus", t.kb_of_nations(), key="o_orderkey")["report"]
    return found.select("algorithm", "confidence", "explanation", F.to_json("issues").alias("issues"))


@query("kb_seed")
def _(t):
    from sondage.operators.seeding import seed

    df = t.doc().join(t.documents.select("doc_id", F.length("text").alias("text_length")), "doc_id")
    kb = seed(df, "lang", "doc_id", ["n_chars", "text_length"], "quality")
    return kb.results.join(kb.experiments.select("experiment_id", "dataset_name", "n_instances"), "experiment_id").drop("experiment_id")
