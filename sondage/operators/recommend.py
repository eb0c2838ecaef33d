"""Similarity search, rankings and the meta-model over the knowledge base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.scalars import confidence_label
from sondage.operators import advise, metafeatures
from sondage.operators.profile import union_all
from sondage.operators.select import explanation
from sondage.plans.neighbours import TIE_DIGITS, nearest, unit_vectors
from sondage.sources.knowledge import KnowledgeBase

# The ranking used when nothing has been learned yet.
DEFAULT_ALGORITHMS = ["RandomForest", "GradientBoosting", "LogisticRegression", "SVM", "KNN"]
DEFAULT_PROBABILITY = 0.2
MIN_TRAINING_ROWS = 5
# Meta-features the meta-model does not use.
UNUSED_FEATURES = ["l1_n_numerical", "l1_n_categorical"]


# -- reading the base ------------------------------------------------------------------------


def pivot(kb: KnowledgeBase, names: Sequence[str] | None = None) -> DataFrame:
    return kb.wide(names).join(kb.experiments.select("experiment_id", "dataset_hash"), "experiment_id")


def winners(results: DataFrame) -> DataFrame:
    """Results equal to their experiment's best F1, ties kept."""
    best = results.groupBy("experiment_id").agg(F.max("f1_score").alias("best_f1"))
    return results.join(best, "experiment_id").where(F.col("f1_score") == F.col("best_f1")).drop("best_f1")


def single_winner(results: DataFrame) -> DataFrame:
    """One winner per experiment, the first name on ties."""
    order = F.struct(-F.col("f1_score"), F.col("algorithm_name"))
    return results.where(F.col("f1_score").isNotNull()).groupBy("experiment_id").agg(
        F.min_by("algorithm_name", order).alias("algorithm_name"), F.max("f1_score").alias("f1_score")
    )


def algorithm_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("algorithm_name").agg(
        F.count(F.lit(1)).alias("n_experiments"), F.avg("f1_score").alias("avg_f1"), F.avg("accuracy").alias("avg_accuracy"),
        F.max("f1_score").alias("max_f1"), F.min("f1_score").alias("min_f1"),
        F.coalesce(F.stddev_samp("f1_score"), F.lit(0.0)).alias("std_f1"),
    )


def system_stats(kb: KnowledgeBase, model_trained: bool) -> DataFrame:
    stats = algorithm_stats(kb.results).select(
        F.lit("algorithm").alias("kind"), F.col("algorithm_name").alias("name"), F.col("avg_f1").alias("value"))
    count = kb.experiments.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("system").alias("kind"), F.lit("experiments").alias("name"), "value")
    flag = kb.experiments.agg(F.lit(float(model_trained)).alias("value")).select(
        F.lit("system").alias("kind"), F.lit("model_trained").alias("name"), "value")
    return union_all([stats, count, flag])


# -- similarity ------------------------------------------------------------------------------


def similar_experiments(kb: KnowledgeBase, query: dict[str, float], k: int = 5) -> DataFrame:
    """Cosine top-k of one query vector over the base's features.

    A missing feature is 0 on either side; a zero vector has similarity 0.  The
    query is a handful of literals, so one pass over the long features with
    map-side combine is enough.
    """
    names = kb.feature_names()
    known = {f: float(query.get(f) or 0.0) for f in names}
    weights = F.create_map(*[x for f, v in known.items() for x in (F.lit(f), F.lit(v))]) if known else F.create_map(
        F.lit(""), F.lit(0.0))
    q = F.coalesce(F.try_element_at(weights, F.col("feature_name")), F.lit(0.0))
    v = F.coalesce("feature_value", F.lit(0.0))
    norm = sum(x * x for x in known.values()) ** 0.5
    sums = kb.features.groupBy("experiment_id").agg(F.sum(q * v).alias("dot"), F.sum(v * v).alias("vv"))
    score = F.coalesce(F.try_divide(F.col("dot"), F.sqrt("vv") * F.lit(norm)), F.lit(0.0))
    scored = kb.experiments.select("experiment_id").join(sums, "experiment_id", "left").select(
        "experiment_id", score.alias("similarity"))
    return scored.orderBy(F.round("similarity", TIE_DIGITS).desc(), "experiment_id").limit(k)


def vectors(kb: KnowledgeBase, names: Sequence[str] | None = None) -> DataFrame:
    """(experiment_id, vec) with missing features as 0."""
    names = list(names) if names else kb.feature_names()
    wide = kb.wide(names)
    return wide.select("experiment_id", F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]).alias("vec"))


def similar_pairs(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, exclude_self: bool = False) -> DataFrame:
    """(query, neighbour, similarity, rank): cosine top-k of many queries at once, without an all-pairs join."""
    near = nearest(
        unit_vectors(queries, vector, True), unit_vectors(base, vector, False), k, key, vector, exclude_self=exclude_self
    )
    similarity = F.lit(1.0) - F.col("distance") * F.col("distance") / 2
    return near.select("query", "neighbour", similarity.alias("similarity"), "rank")


def similarity_vote(neighbours: DataFrame, results: DataFrame) -> DataFrame:
    """Mean F1 per algorithm over the neighbours (a missing F1 counts 0), ranked."""
    rows = neighbours.select(F.col("experiment_id")).join(results, "experiment_id")
    votes = rows.groupBy("algorithm_name").agg(F.avg(F.coalesce("f1_score", F.lit(0.0))).alias("avg_f1"))
    # One row per algorithm.
    return votes.withColumn("rank", F.row_number().over(W.orderBy(F.col("avg_f1").desc(), "algorithm_name")))


def default_ranking(datasets: DataFrame, key: str) -> DataFrame:
    """The fixed ranking for every dataset that has no learned one."""
    items = F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(a).alias("algorithm"), F.lit(DEFAULT_PROBABILITY).alias("probability"))
        for i, a in enumerate(DEFAULT_ALGORITHMS)
    ])
    return datasets.select(key, F.inline(items))


def combine_rankings(model: DataFrame, votes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Blend model probabilities and similarity scores.

    ``model`` is (by..., algorithm, probability, rank), ``votes`` (by...,
    algorithm, avg_f1).  Score = probability / rank + avg_f1 / 2, where an
    algorithm without votes scores as 0.5 and is reported as 0.
    """
    by = list(by)
    joined = model.join(votes.select(*by, "algorithm", "avg_f1"), [*by, "algorithm"], "left")
    score = F.col("probability") / F.col("rank") + F.coalesce("avg_f1", F.lit(0.5)) * 0.5
    scored = joined.select(
        *by, "algorithm", score.alias("combined_score"), F.col("probability").alias("rf_probability"),
        F.coalesce("avg_f1", F.lit(0.0)).alias("similarity_f1"), F.col("rank").alias("_rank"),
    )
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    # A group holds one row per algorithm.
    place = F.row_number().over(group.orderBy(F.round("combined_score", TIE_DIGITS).desc(), "_rank", "algorithm"))
    return scored.withColumn("rank", place).drop("_rank")


# -- the meta-model --------------------------------------------------------------------------


def training_set(kb: KnowledgeBase, names: Sequence[str] | None = None) -> DataFrame:
    """Wide features and the winner, joined on the experiment id; missing as 0."""
    names = [n for n in (names or kb.feature_names()) if n not in UNUSED_FEATURES]
    wide = kb.wide(names).na.fill(0.0, names)
    label = single_winner(kb.results).select("experiment_id", F.col("algorithm_name").alias("winner"))
    return wide.join(label, "experiment_id")


def meta_train(examples: DataFrame, trees: int = 100, depth: int = 10):
    """Forest over the training set, or None when it has fewer than five rows."""
    if examples.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        return None
    names = [c for c in examples.columns if c not in ("experiment_id", "winner")]
    return Pipeline(stages=[
        StringIndexer(inputCol="winner", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42),
    ]).fit(examples)


def meta_predict(model, wide: DataFrame, key: str) -> DataFrame:
    """(key, algorithm, probability, rank) for every class the model knows; missing features as 0.

    Without a model the default ranking is returned.
    """
    if model is None:
        return default_ranking(wide, key).select(key, "algorithm", "probability", "rank")
    indexer, assembler = model.stages[0], model.stages[1]
    names = assembler.getInputCols()
    present = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in wide.columns else F.lit(0.0).alias(n) for n in names]
    scored = model.transform(wide.select(key, *present, F.lit(indexer.labels[0]).alias("winner")))
    labels = F.array(*[F.lit(x) for x in indexer.labels])
    rows = scored.select(key, F.posexplode(vector_to_array("probability")).alias("i", "probability")).where(
        F.col("i") < len(indexer.labels)
    ).select(key, labels[F.col("i")].alias("algorithm"), "probability")
    order = W.partitionBy(key).orderBy(F.col("probability").desc(), "algorithm")
    return rows.withColumn("rank", F.row_number().over(order))


def leave_one_out(examples: DataFrame, k: int = 3) -> DataFrame:
    """Quality of the 1-NN recommender: each experiment is predicted from the others.

    precision@1 compares winners; precision@k and nDCG rank the winners of the
    ``k`` nearest experiments.
    """
    names = [c for c in examples.columns if c not in ("experiment_id", "winner")]
    points = examples.select("experiment_id", F.array(*names).alias("vec"))
    near = similar_pairs(points, points, k, "experiment_id", "vec", exclude_self=True)
    truth = examples.select(F.col("experiment_id").alias("query"), F.col("winner").alias("true_winner"))
    guess = examples.select(F.col("experiment_id").alias("neighbour"), F.col("winner").alias("guess"))
    rows = near.join(truth, "query").join(guess, "neighbour")
    hit = F.col("guess") == F.col("true_winner")
    per = rows.groupBy("query").agg(
        F.max(F.when((F.col("rank") == 1) & hit, 1.0).otherwise(0.0)).alias("p1"),
        F.max(F.when(hit, 1.0).otherwise(0.0)).alias("pk"),
        F.max(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"),
    )
    return per.agg(
        F.coalesce(F.avg("p1"), F.lit(0.0)).alias("precision_at_1"), F.coalesce(F.avg("pk"), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.count(F.lit(1)).alias("n_samples"),
    )


# -- the whole path --------------------------------------------------------------------------


def recommend(df: DataFrame, target: str, kb: KnowledgeBase, k: int = 5, key: str | None = None) -> dict[str, DataFrame]:
    """Characterise a table and rank algorithms for it.

    Returns ``meta`` (long features, with the landmarks if there is a ``key``), ``similar`` experiments, the blended
    ``ranking`` with its confidence, the ``report`` (the best algorithm and why), the quality ``issues``
    and their ``health`` summary.
    """
    wide = metafeatures.extract(df, target, key).withColumn("dataset", F.lit("this"))
    facts = wide.first().asDict()
    vector = {n: float(v or 0.0) for n, v in facts.items() if n != "dataset"}
    row = df.sparkSession.createDataFrame([("this", *vector.values())], ["dataset", *vector])
    names = [n for n in kb.feature_names() if n in vector]
    model = meta_train(training_set(kb, names)) if names else None
    predicted = meta_predict(model, row, "dataset")
    similar = similar_experiments(kb, vector, k)
    votes = similarity_vote(similar, kb.results).select(F.col("algorithm_name").alias("algorithm"), "avg_f1")
    bare = df.drop(key) if key else df
    issues = advise.advise(bare, target)
    health = advise.health_summary(issues)
    ranking = combine_rankings(predicted.drop("dataset"), votes).withColumn("confidence", confidence_label(F.col("combined_score")))
    return {
        "meta": metafeatures.to_long(row, ["dataset"]).drop("dataset"),
        "similar": similar,
        "ranking": ranking,
        "report": report(row, ranking, similar, issues),
        "issues": issues,
        "health": health,
    }


def report(vector: DataFrame, ranking: DataFrame, similar: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: the best algorithm, its score and confidence, the reasons for it, and how many issues of each severity there are.

    Landmarks that were not taken count as 0, as an unscored one does.
    """
    best = ranking.where("rank = 1").select("algorithm", "combined_score", "confidence")
    found = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("issues"))

    def feature(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in vector.columns else F.lit(0.0)

    reasons = explanation(feature("l1_n_instances"), feature("l1_imbalance_ratio"), feature("l4_landmark_dt"), feature("l4_landmark_nb"),
                          similar.agg(F.count(F.lit(1))).scalar())
    return vector.select(
        best.select("algorithm").scalar().alias("algorithm"), best.select("combined_score").scalar().alias("combined_score"),
        best.select("confidence").scalar().alias("confidence"), F.array_join(reasons, " | ").alias("explanation"),
        found.select("issues").scalar().alias("issues"))


# -- ranking quality -------------------------------------------------------------------------


def precision_at_k(df: DataFrame, true_items: str, predicted: str, k: int, out: str = "precision_at_k") -> DataFrame:
    """Share of the first k true items found anywhere in the ranking, over least(k, true items)."""
    wanted = F.slice(F.col(true_items), 1, max(k, 1))
    found = F.size(F.array_intersect(wanted, F.col(predicted)))
    value = F.try_divide(found.cast("double"), F.least(F.lit(k), F.size(true_items)).cast("double"))
    return df.withColumn(out, F.coalesce(value, F.lit(0.0)) if k > 0 else F.lit(0.0))


def ndcg_at_k(df: DataFrame, relevance: str, k: int, out: str = "ndcg_at_k") -> DataFrame:
    """Gain (2^rel - 1) / log2(position + 1) of the first k, over the same in the best order of those k."""
    first = F.slice(F.col(relevance).cast("array<double>"), 1, k)

    def gain(items):
        weighted = F.transform(items, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i.cast("double") + 2))
        return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)

    best = gain(F.sort_array(first, asc=False))
    return df.withColumn(out, F.coalesce(F.try_divide(gain(first), best), F.lit(0.0)))
