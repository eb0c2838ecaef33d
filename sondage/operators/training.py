"""Training, benchmarking and explaining models with Spark ML.

Every fit is a distributed job.  A small driver pool only keeps the cluster busy
while several models or folds are fitted.  Preprocessing is fitted once per
training set, its output is written once, and each (model, fold) is fitted once:
all metrics come from one predictions table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.scalars import hash_fraction, sigmoid
from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators import landmarks, metrics, prepare
from sondage.operators.profile import union_all
from sondage.plans.durable import materialise
from sondage.plans.neighbours import nearest
from sondage.plans.ordering import dictionary, hash_ranks

POOL = 4
SEED = 42
UNBOUNDED_DEPTH = 30  # the deepest tree Spark allows
ELIMINATION_ITERATIONS = 700


# -- evaluation ------------------------------------------------------------------------------


def evaluate(predictions: DataFrame, task: str = "classification", by: Sequence[str] = ()) -> DataFrame:
    """Headline metrics of a predictions table, one row per group."""
    if task == "regression":
        return metrics.regression_metrics(predictions, by)
    table = metrics.summary(predictions, by).select(
        *by, "accuracy", "balanced_accuracy", F.col("precision_weighted").alias("precision"),
        F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"), F.col("f2_weighted").alias("f2"),
    )
    if "score" in predictions.columns:
        area = metrics.roc_auc(predictions, by).select(*by, "roc_auc")
    elif "proba" in predictions.columns:
        area = metrics.roc_auc_ovr(predictions, by).select(*by, F.col("auc_weighted").alias("roc_auc"))
    else:
        return table.withColumn("roc_auc", F.lit(None).cast("double"))
    return table.join(area, list(by), "left") if by else table.join(F.broadcast(area), F.lit(True))


# -- model catalog ---------------------------------------------------------------------------


def model_catalog(
    task: str, n_classes: int = 2, n_features: int | None = None, fast: bool = True, weight: str | None = None
) -> dict[str, object]:
    """Estimators by name.  Boosted trees stand in for external boosters; what Spark lacks is left out."""
    trees, depth = (80, 4) if fast else (200, 5)
    weighted = {"weightCol": weight} if weight else {}
    if task == "regression":
        return {
            "LinearRegression": LinearRegression(),
            "RandomForest": RandomForestRegressor(numTrees=trees, maxDepth=UNBOUNDED_DEPTH, seed=SEED),
            "GradientBoosting": GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.05, seed=SEED),
            "DecisionTree": DecisionTreeRegressor(maxDepth=depth, seed=SEED),
            "GeneralizedLinear": GeneralizedLinearRegression(family="gaussian"),
        }
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.05, seed=SEED)
    margin = LinearSVC(maxIter=50, regParam=0.01)
    catalog = {
        "LogisticRegression": LogisticRegression(maxIter=500, **weighted),
        "RandomForest": RandomForestClassifier(numTrees=trees, maxDepth=UNBOUNDED_DEPTH, seed=SEED, **weighted),
        "GradientBoosting": boosted if n_classes == 2 else OneVsRest(classifier=boosted),
        "LinearSVM": margin if n_classes == 2 else OneVsRest(classifier=margin),
        "DecisionTree": DecisionTreeClassifier(maxDepth=10, seed=SEED, **weighted),
        "NaiveBayes": NaiveBayes(modelType="gaussian"),
    }
    if n_features:
        hidden = [32, 16] if fast else [64, 32]
        catalog["NeuralNetwork"] = MultilayerPerceptronClassifier(
            layers=[n_features, *hidden, n_classes], maxIter=80 if fast else 200, seed=SEED)
    return catalog


def benchmark_catalog(n_classes: int = 2) -> dict[str, object]:
    """The estimators of the benchmarks, which have settings of their own."""
    boosted = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
    margin = LinearSVC(maxIter=1000, regParam=0.01)
    return {
        "LogisticRegression": LogisticRegression(maxIter=1000),
        "RandomForest": RandomForestClassifier(numTrees=100, maxDepth=UNBOUNDED_DEPTH, seed=SEED),
        "GradientBoosting": boosted if n_classes == 2 else OneVsRest(classifier=boosted),
        "LinearSVM": margin if n_classes == 2 else OneVsRest(classifier=margin),
        "DecisionTree": DecisionTreeClassifier(maxDepth=10, seed=SEED),
        "NaiveBayes": NaiveBayes(modelType="gaussian"),
    }


def _predictions(scored: DataFrame, n_classes: int | None, keep: Sequence[str]) -> DataFrame:
    """One shape for every classifier: keep..., y, y_hat, proba."""
    if "probability" in scored.columns:
        proba = vector_to_array("probability")
    elif "rawPrediction" in scored.columns and n_classes == 2:
        p = sigmoid(vector_to_array("rawPrediction")[1])
        proba = F.array(F.lit(1.0) - p, p)
    else:
        proba = F.transform(
            F.sequence(F.lit(0), F.lit((n_classes or 2) - 1)), lambda i: (i == F.col("prediction")).cast("double"))
    return scored.select(*keep, F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("y_hat"), proba.alias("proba"))


# -- preparation -----------------------------------------------------------------------------


def labelled(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    """Rows with a target, ``label`` its class number; also the classes in order."""
    rows = df.where(F.col(target).isNotNull())
    numbers = materialise(dictionary(rows, target, "label"), "classes")
    classes = landmarks.class_list(numbers, target)
    # The number of classes goes with the column: without it learners refuse more than a hundred.
    label = F.col("label").cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": len(classes)}})
    coded = rows.drop("label").join(numbers.select(F.col(target), label), target)
    return coded.select(*[c for c in rows.columns if c != "label"], "label"), classes


def prepared(train: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, Callable[[DataFrame], DataFrame]]:
    """Preprocessing fitted on ``train`` only, and the function that casts its inputs."""
    numeric = [f for f in features if f in set(numeric_columns(train))]
    categorical = [f for f in features if f in set(categorical_columns(train))]

    def cast(df):
        return prepare.as_doubles(df, numeric)

    return prepare.preparation(numeric, categorical).fit(cast(train)), cast


def vector_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Names of the assembled vector's places: numeric names, then ``column_value``."""
    labels = {}
    for stage in model.stages:
        if hasattr(stage, "labels"):
            labels[stage.getInputCol()] = list(stage.labels)
    return list(numeric) + [f"{c}_{v}" for c in categorical for v in labels.get(c, [])]


# -- cross-validation ------------------------------------------------------------------------


def fold_tables(df: DataFrame, key: str, features: Sequence[str], target: str, folds: int):
    """Per fold the written (train, test) tables of vectors, preprocessing fitted inside the fold."""
    rows, classes = labelled(df, target)
    assigned, k = landmarks.with_folds(rows.select(key, "label", *features), key, "label", folds)
    out = []
    for g in range(k):
        train, test = assigned.where(F.col("fold") != g), assigned.where(F.col("fold") == g)
        model, cast = prepared(train, features)
        both = model.transform(cast(assigned)).select(key, "fold", "label", "features")
        both = materialise(both, f"fold{g}")
        out.append((g, both.where(F.col("fold") != g), both.where(F.col("fold") == g)))
    return out, classes


def knn_fold(key: str, train: DataFrame, test: DataFrame, neighbours: int, n_classes: int) -> DataFrame:
    as_array = vector_to_array("features").alias("vec")
    near = nearest(test.select(key, as_array), train.select(key, as_array), neighbours, key, "vec")
    votes = near.join(train.select(F.col(key).alias("neighbour"), "label"), "neighbour").groupBy("query").agg(*[
        F.avg((F.col("label") == c).cast("double")).alias(f"p{c}") for c in range(n_classes)])
    proba = F.array(*[F.col(f"p{c}") for c in range(n_classes)])
    return test.select(F.col(key).alias("query"), "fold", "label").join(
        votes.select("query", proba.alias("proba")), "query").select(
        F.col("query").alias(key), "fold", F.col("label").cast("int").alias("y"),
        (F.array_position("proba", F.array_max("proba")) - 1).cast("int").alias("y_hat"), "proba")


def cross_validate(
    df: DataFrame, key: str, features: Sequence[str], target: str, algorithms: Sequence[str], folds: int = 5
) -> DataFrame:
    """Predictions (model, key, fold, y, y_hat, proba) of every algorithm, each (model, fold) fitted once."""
    tables, classes = fold_tables(df, key, features, target, folds)
    n_classes = len(classes)
    catalog = benchmark_catalog(n_classes)

    def run(job):
        name, (g, train, test) = job
        if name == "KNN":
            out = knn_fold(key, train, test, 5, n_classes)
        else:
            out = _predictions(catalog[name].copy().fit(train).transform(test), n_classes, [key, "fold"])
        return materialise(out.withColumn("model", F.lit(name)), "predictions")

    with ThreadPool(POOL) as pool:
        parts = pool.map(run, [(a, t) for a in algorithms for t in tables], chunksize=1)
    return union_all(parts)


# The algorithms of the two benchmarks.
BENCHMARK_5 = ["RandomForest", "GradientBoosting", "LogisticRegression", "LinearSVM", "KNN"]
BENCHMARK_7 = [*BENCHMARK_5, "DecisionTree", "NaiveBayes"]


def benchmark(predictions: DataFrame, with_auc: bool = False) -> DataFrame:
    """Per model mean, deviation and fold scores of each metric; the best model by mean F1 marked."""
    names = ["f1_weighted", "accuracy", "precision_weighted", "recall_weighted", "f1_macro"]
    folds = metrics.summary(predictions, ["model", "fold"]).select("model", "fold", *names)
    if with_auc:
        area = metrics.roc_auc_ovr(predictions, ["model", "fold"]).select("model", "fold", F.col("auc_weighted").alias("roc_auc"))
        folds, names = folds.join(area, ["model", "fold"]), [*names, "roc_auc"]
    out = []
    for m in names:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", m))), lambda s: s[m])
        out += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"), ordered.alias(f"{m}_scores")]
    table = folds.groupBy("model").agg(*out, F.count(F.lit(1)).alias("cv_folds"))
    best = table.agg(F.min_by("model", F.struct(-F.col("f1_weighted"), F.col("model")))).scalar()
    return table.withColumn("is_best", F.col("model") == best)


def top_models(benchmarked: DataFrame, n: int = 3) -> DataFrame:
    return benchmarked.orderBy(F.col("f1_weighted").desc(), "model").limit(n)


# -- automatic training ----------------------------------------------------------------------


class Trained:
    """Result of :func:`train_models`: leaderboard, predictions, fitted models and preprocessing."""

    def __init__(self, board: DataFrame, predictions: DataFrame, models: dict[str, Model], preparation: PipelineModel,
                 names: list[str], classes: list, train: DataFrame, test: DataFrame):
        self.board, self.predictions, self.models = board, predictions, models
        self.preparation, self.names, self.classes, self.train, self.test = preparation, names, classes, train, test

    def pipeline(self, name: str) -> PipelineModel:
        return PipelineModel(stages=[*self.preparation.stages, self.models[name]])


def train_models(
    df: DataFrame, key: str, features: Sequence[str], target: str, task: str = "classification",
    algorithms: Sequence[str] | None = None, fast: bool = True, test_share: float = 0.2,
    progress: Callable[[str, str], None] | None = None,
) -> Trained:
    """Split, prepare, fit the catalog, rank.  A model that fails becomes a row with its status."""
    features = list(features)
    if task == "classification":
        rows, classes = labelled(df, target)
        split = prepare.stratified_split(rows.select(key, "label", *features), key, "label", test_share, SEED)
        split = prepare.with_class_weights(split, "label")
    else:
        from sondage.operators.select import coerce_numeric_target

        rows, classes = coerce_numeric_target(df, target).withColumn("label", F.col(target)), []
        ranked = hash_ranks(rows.select(key, "label", *features), key, SEED)
        split = ranked.withColumn("is_test", F.col("rn") <= F.ceil(F.col("group_size") * F.lit(test_share))).withColumn(
            "weight", F.lit(1.0))
    split = materialise(split, "split")
    model, cast = prepared(split.where(~F.col("is_test")), features)
    vectors = materialise(model.transform(cast(split)).select(key, "label", "weight", "is_test", "features"), "vectors")
    train, test = vectors.where(~F.col("is_test")), vectors.where(F.col("is_test"))
    numeric = [f for f in features if f in set(numeric_columns(df))]
    names = vector_names(model, numeric, [f for f in features if f in set(categorical_columns(df))])
    width = train.select(F.size(vector_to_array("features"))).first()[0]
    catalog = model_catalog(task, len(classes), width, fast, weight="weight")
    chosen = list(algorithms or catalog)

    def run(name):
        start = time.perf_counter()
        try:
            fitted = catalog[name].fit(train)
            scored = fitted.transform(test)
            if task == "classification":
                out = _predictions(scored, len(classes), [key])
            else:
                out = scored.select(key, F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
            out, status = materialise(out.withColumn("model", F.lit(name)), "predictions"), "ok"
        except Exception as error:  # a failed model is a result, not the end of the run
            fitted, out, status = None, None, f"failed: {type(error).__name__}"
        if progress:
            progress(name, status)
        return name, fitted, out, status, time.perf_counter() - start

    with ThreadPool(POOL) as pool:
        done = pool.map(run, chosen, chunksize=1)
    spark = df.sparkSession
    status = spark.createDataFrame([(n, s, t) for n, _, _, s, t in done], "model string, status string, seconds double")
    parts = [o for _, _, o, _, _ in done if o is not None]
    if not parts:
        raise RuntimeError(f"no model could be fitted: {[s for *_, s, _ in done]}")
    predictions = union_all(parts)
    score = "f1" if task == "classification" else "r2"
    table = status.join(evaluate(predictions, task, ["model"]), "model", "left")
    board = metrics.leaderboard(table, score=score)
    return Trained(board, predictions, {n: m for n, m, *_ in done if m is not None}, model, names, classes, train, test)


# -- persistence and scoring -----------------------------------------------------------------


def save_model(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)


def batch_score(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """Score a batch or a stream with a saved pipeline."""
    return model.transform(rows).select(key, "prediction")


# -- curves ----------------------------------------------------------------------------------


def learning_curve(
    df: DataFrame, key: str, features: Sequence[str], target: str, estimator, sizes: Sequence[float], folds: int = 5
) -> DataFrame:
    """(share, train_score mean/std, validation_score mean/std); training sets are nested hash-ordered prefixes."""
    tables, classes = fold_tables(df, key, features, target, folds)

    def run(job):
        (g, train, test), share = job
        ranked = hash_ranks(train, key, SEED)
        part = ranked.where(F.col("rn") <= F.ceil(F.col("group_size") * F.lit(float(share)))).select(*train.columns)
        f1 = _both_scores(estimator.copy().fit(part), part, test, len(classes))
        return materialise(f1.withColumn("fold", F.lit(g)).withColumn("share", F.lit(float(share))), "curve")

    with ThreadPool(POOL) as pool:
        parts = pool.map(run, [(t, s) for s in sizes for t in tables], chunksize=1)
    return _curve(union_all(parts), "share")


# Depths of the validation curve, None meaning as deep as Spark allows.
CURVE_DEPTHS = [3, 5, 8, 12, None]


def validation_curve(
    df: DataFrame, key: str, features: Sequence[str], target: str, depths: Sequence[int | None] = CURVE_DEPTHS,
    folds: int = 5, trees: int = 80,
) -> DataFrame:
    """(max_depth, train and validation score, each mean and deviation) of a forest; preprocessing is fitted inside each fold."""
    tables, classes = fold_tables(df, key, features, target, folds)

    def run(job):
        (g, train, test), depth = job
        forest = RandomForestClassifier(numTrees=trees, seed=SEED, maxDepth=UNBOUNDED_DEPTH if depth is None else depth)
        f1 = _both_scores(forest.fit(train), train, test, len(classes))
        name = F.lit("unbounded" if depth is None else str(depth)).alias("max_depth")
        return materialise(f1.select("side", "f1", F.lit(g).alias("fold"), name), "curve")

    with ThreadPool(POOL) as pool:
        parts = pool.map(run, [(t, d) for d in depths for t in tables], chunksize=1)
    return _curve(union_all(parts), "max_depth").orderBy(F.col("max_depth") == "unbounded", F.col("max_depth").try_cast("int"))


def _both_scores(model, train: DataFrame, test: DataFrame, n_classes: int) -> DataFrame:
    """(side, f1): weighted F1 on the rows a model was fitted on and on those held out."""
    scored = [
        _predictions(model.transform(rows), n_classes, []).select("y", "y_hat").withColumn("side", F.lit(side))
        for rows, side in ((train, "train"), (test, "validation"))]
    return metrics.summary(union_all(scored), ["side"]).select("side", F.col("f1_weighted").alias("f1"))


def _curve(scores: DataFrame, by: str) -> DataFrame:
    """Mean and deviation over the folds of (side, f1, by)."""
    on_train, on_test = F.col("side") == "train", F.col("side") == "validation"
    return scores.groupBy(by).agg(
        F.avg(F.when(on_train, F.col("f1"))).alias("train_score"), F.stddev_pop(F.when(on_train, F.col("f1"))).alias("train_std"),
        F.avg(F.when(on_test, F.col("f1"))).alias("validation_score"), F.stddev_pop(F.when(on_test, F.col("f1"))).alias("validation_std"))


def feature_importance(model, names: Sequence[str], spark, top: int | None = 20) -> DataFrame:
    """(feature, importance, rank): tree importances, or absolute coefficients (mean over classes)."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        values = []
    pairs = sorted(zip(names, map(float, values)), key=lambda p: (-p[1], p[0]))[:top]
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(pairs)], "feature string, importance double, rank int")


def linear_attribution(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, mean_abs): exact additive attribution coef * (x - mean x) of a linear model."""
    names = list(coefficients)
    mean = df.agg(*[F.avg(n).alias(n) for n in names]).first()
    parts = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.abs(F.lit(float(c)) * (F.col(n) - F.lit(mean[n]))).alias("a"))
        for n, c in coefficients.items()])
    return df.select(F.inline(parts)).groupBy("feature").agg(F.avg("a").alias("mean_abs"))


def permutation_importance(model, test: DataFrame, key: str, names: Sequence[str], n_classes: int, seed: int = SEED) -> DataFrame:
    """(feature, drop in weighted F1) when a feature's values are exchanged between rows.

    Row r receives the value of the row with hash rank r + 1 (the last one the
    first's): a repeatable permutation by an equi-join on ranks.
    """
    ranked = materialise(hash_ranks(test.select(key, "label", vector_to_array("features").alias("v")), key, seed), "permute")
    donor = ranked.select((F.col("rn") % F.col("group_size") + 1).alias("rn"), F.col("v").alias("w"))
    both = materialise(ranked.select(key, "label", "rn", "v").join(donor, "rn"), "permuted")

    # Place -1 is the untouched row; one scoring pass serves the baseline and every feature.
    places = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))
    copies = both.select("label", "v", "w", places.alias("place"))
    mixed = F.zip_with(
        F.transform("v", lambda x, j: F.struct(x.alias("x"), j.alias("j"))), F.col("w"),
        lambda a, b: F.when(a["j"] == F.col("place"), b).otherwise(a["x"]))
    scored = _predictions(
        model.transform(copies.select("label", "place", array_to_vector(mixed).alias("features"))), n_classes, ["place"])
    f1 = materialise(metrics.summary(scored, ["place"]).select("place", F.col("f1_weighted").alias("f1")), "f1")
    baseline = f1.where(F.col("place") == -1).select("f1").scalar()
    labels = F.array(*[F.lit(n) for n in names])
    return f1.where(F.col("place") >= 0).select(
        labels[F.col("place")].alias("feature"), (baseline - F.col("f1")).alias("importance"))


def local_attribution(
    model, row: Sequence[float], scale: Sequence[float], names: Sequence[str], spark, samples: int = 2000,
    top: int = 12, seed: int = SEED,
) -> DataFrame:
    """(feature, contribution): weights of a local linear fit around one row.

    ``samples`` perturbed rows are generated as a distributed range, scored by
    the model, weighted by closeness, and fitted with a weighted ridge regression.
    """
    width = len(row)
    deviates = []
    for j in range(width):
        text = F.concat(F.lit(f"{seed}-{j}-"), F.col("id").cast("string"))
        u1, u2 = F.greatest(hash_fraction(text), F.lit(1e-12)), hash_fraction(text, 9)
        deviates.append(F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2))
    z = F.array(*deviates)
    around = spark.range(samples).withColumn("z", z)
    values = F.array(*[F.lit(float(row[j])) + F.col("z")[j] * F.lit(float(scale[j])) for j in range(width)])
    distance = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    kernel = F.exp(-distance / F.lit(0.75 * 0.75 * width))
    scored = model.transform(around.select("z", kernel.alias("weight"), array_to_vector(values).alias("features")))
    wanted = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    local = scored.select(array_to_vector("z").alias("features"), "weight", wanted.alias("label"))
    fit = LinearRegression(weightCol="weight", regParam=1e-3).fit(local)
    pairs = sorted(zip(names, fit.coefficients.toArray().tolist()), key=lambda p: (-abs(p[1]), p[0]))[:top]
    return spark.createDataFrame([(n, float(v)) for n, v in pairs], "feature string, contribution double")


# -- selection and variants ------------------------------------------------------------------


def kept_places(columns: int) -> int:
    """How many places elimination leaves of a table of so many columns: half of them, two at least and ten at most."""
    return min(10, max(2, columns // 2))


def recursive_elimination(train: DataFrame, width: int, keep: int | None = None, step: int = 1) -> list[int]:
    """Vector places left after dropping the weakest coefficient until ``keep`` remain.

    ``width`` is that of the vector; ``keep`` follows from it unless given, as :func:`kept_places` of the raw columns.
    """
    keep = keep or kept_places(width)
    places = list(range(width))
    while len(places) > keep:
        sliced = VectorSlicer(inputCol="features", outputCol="part", indices=places).transform(train)
        model = LogisticRegression(featuresCol="part", maxIter=ELIMINATION_ITERATIONS).fit(sliced)
        strength = (abs(model.coefficientMatrix.toArray())).sum(axis=0)
        order = sorted(range(len(places)), key=lambda i: (strength[i], -i))
        weak = {places[i] for i in order[:min(step, len(places) - keep)]}
        places = [p for p in places if p not in weak]
    return places


def notebook_variants(df: DataFrame, key: str, features: Sequence[str], target: str) -> DataFrame:
    """(variant, accuracy): logistic regression, the same after oversampling, the same after elimination, a forest."""
    rows, classes = labelled(df, target)
    split = materialise(prepare.stratified_split(rows.select(key, "label", *features), key, "label", 0.2, SEED), "split")
    model, cast = prepared(split.where(~F.col("is_test")), features)
    vectors = prepare.with_class_weights(model.transform(cast(split)).select(key, "label", "is_test", "features"), "label")
    vectors = materialise(vectors, "vectors")
    train, test = vectors.where(~F.col("is_test")), vectors.where(F.col("is_test"))
    width = train.select(F.size(vector_to_array("features"))).first()[0]
    logistic = LogisticRegression(maxIter=ELIMINATION_ITERATIONS, weightCol="weight")

    def accuracy(fitted, rows, name):
        scored = fitted.transform(rows).select((F.col("prediction") == F.col("label")).cast("double").alias("ok"))
        return scored.agg(F.avg("ok").alias("accuracy")).withColumn("variant", F.lit(name))

    arrays = train.select(key, F.col("label").cast("int").alias("label"), vector_to_array("features").alias("v"))
    extra = prepare.smote(arrays, key, "v", "label").select(
        F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    grown = materialise(train.select("label", "features").unionByName(extra), "oversampled")
    places = recursive_elimination(train, width, kept_places(len(features)))
    slicer = VectorSlicer(inputCol="features", outputCol="part", indices=places)
    compact = LogisticRegression(maxIter=ELIMINATION_ITERATIONS, weightCol="weight", featuresCol="part")
    forest = RandomForestClassifier(numTrees=120, maxDepth=UNBOUNDED_DEPTH, seed=SEED, weightCol="weight")
    jobs = [
        lambda: accuracy(logistic.fit(train), test, "LogisticRegression"),
        lambda: accuracy(LogisticRegression(maxIter=ELIMINATION_ITERATIONS).fit(grown), test, "LogisticRegression+SMOTE"),
        lambda: accuracy(compact.fit(slicer.transform(train)), slicer.transform(test), "LogisticRegression+RFE"),
        lambda: accuracy(forest.fit(train), test, "RandomForest"),
    ]
    with ThreadPool(POOL) as pool:
        return union_all(pool.map(lambda job: job(), jobs, chunksize=1))
