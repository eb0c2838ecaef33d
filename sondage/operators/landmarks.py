"""Landmarks: quick cross-validated scores of very simple models.

Stump and Gaussian naive Bayes are exact and need only grouped sums: the counts
of a training fold are the totals minus the held-out fold, so one pass serves
all folds.  kNN is the exact neighbour join.  Each landmark returns per-fold
rows (fold, f1) or, when it cannot run, one row with a reason.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import metrics
from sondage.operators.grouped import fold_f1, stump_cells
from sondage.operators.prepare import kfold_assign, safe_folds
from sondage.operators.profile import clean, column_aggregates, union_all
from sondage.plans.durable import materialise
from sondage.plans.neighbours import nearest
from sondage.plans.quantiles import column_quantiles

TINY = 1e-300  # variance of a feature that never varies


def with_folds(df: DataFrame, key: str, target: str, folds: int = 5, seed: int = 42) -> tuple[DataFrame, int]:
    """Rows with a stratified ``fold``, written once, and least(folds, rows, smallest class)."""
    k = safe_folds(df, target, folds)
    return materialise(kfold_assign(df, key, target, max(k, 1), seed), "folds"), k


def class_list(df: DataFrame, target: str) -> list:
    """The classes in order: a fitted model has parameters for each, so they fit where it does."""
    return sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().collect())


def _fold_scores(predictions: DataFrame) -> DataFrame:
    return metrics.summary(predictions, ["fold"]).select("fold", F.col("f1_weighted").alias("f1"))


def _unavailable(df: DataFrame, reason: str) -> DataFrame:
    row = "fold int, f1 double, reason string"
    return df.sparkSession.createDataFrame([(None, None, reason)], row)


def summarise(scores: DataFrame) -> DataFrame:
    """(f1, folds, reason): mean over the folds; null with a reason when there are none."""
    names = scores.columns
    reason = F.first("reason") if "reason" in names else F.lit(None).cast("string")
    return scores.agg(F.avg("f1").alias("f1"), F.count("f1").alias("folds"), reason.alias("reason"))


# -- stump -----------------------------------------------------------------------------------


def stump(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    """Depth-1 tree per training fold by weighted Gini, cut at data values, scored on its fold.

    ``df`` carries ``fold``.  The table is collapsed to counts per (feature, value, fold, class);
    classes are rows, so their number is free (see ``grouped.stump_cells``).  Ties take the first feature, then the lowest cut.
    Nulls count at the median of the training fold.
    """
    if k < 2:
        return _unavailable(df, "fewer than two folds")
    ordered = sorted(features)
    rows = df.where(F.col(target).isNotNull()).select(
        F.lit("").alias("set"), "fold", F.col(target).cast("string").alias("y"), *[clean(f).cast("double").alias(f"x{j}") for j, f in enumerate(ordered)])
    x = F.array(*[F.col(f"x{j}") for j in range(len(ordered))])
    cells = materialise(rows.select("set", "fold", "y", F.posexplode(x).alias("j", "value")).groupBy("set", "fold", "y", "j", "value").agg(
        F.count(F.lit(1)).alias("n")), "stump")
    known, lost = cells.where("value is not null"), cells.where("value is null")
    middle = _medians(rows, [f"x{r[0]}" for r in lost.select("j").distinct().collect()], k)
    others = F.explode(F.filter(F.array(*[F.lit(g) for g in range(k)]), lambda g: g != F.col("fold"))).alias("g")
    train, held = known.select("set", "j", "value", "y", "n", others), known
    if middle:
        # One row per fold and column with gaps.
        places = F.broadcast(df.sparkSession.createDataFrame(middle, "g int, j int, value double"))
        lost = lost.drop("value")
        train = train.unionByName(lost.select("set", "j", "y", "n", others).join(places, ["g", "j"]))
        held = held.unionByName(lost.join(places.withColumnRenamed("g", "fold"), ["fold", "j"]))
    train = train.groupBy("g", "set", "j", "value", "y").agg(F.sum("n").alias("n"))
    held = held.groupBy("set", "fold", "j", "value", "y").agg(F.sum("n").alias("n"))
    return fold_f1(stump_cells(materialise(train, "stump-train"), held, relative=False)).select("fold", "f1")


def _medians(rows: DataFrame, names: Sequence[str], k: int) -> list[tuple[int, int, float]]:
    """``(g, j, median)`` of the columns over the rows outside fold g; 0 without any value."""
    out = []
    for g in range(k if names else 0):
        known = column_quantiles(rows.where(F.col("fold") != g), list(names), [0.5])
        out += [(g, int(n[1:]), float(known[n][0]) if n in known and known[n][0] is not None else 0.0) for n in names]
    return out


# -- Gaussian naive Bayes --------------------------------------------------------------------


def gaussian_nb(
    df: DataFrame, features: Sequence[str], target: str, k: int, smoothing: float = 1e-9
) -> DataFrame:
    """Per-class means and variances of each training fold, log-likelihood on the held-out one.

    Sums are taken around the column mean, which keeps the variance accurate.
    The parameters (folds x classes x features numbers) return to the plan as
    one broadcast row per fold.
    """
    if k < 2:
        return _unavailable(df, "fewer than two folds")
    classes = class_list(df, target)
    facts = column_aggregates(df, features, lambda f: {"m": F.avg(clean(f)), "v": F.var_pop(clean(f))}).collect()
    centre = {r["feature"]: r["m"] or 0.0 for r in facts}
    floor = smoothing * max((r["v"] or 0.0 for r in facts), default=0.0)
    x = [F.coalesce(clean(f), F.lit(centre[f])) - F.lit(centre[f]) for f in features]
    rows = df.where(F.col(target).isNotNull()).select(
        "fold", F.col(target).alias("y"), *[e.alias(f"x{i}") for i, e in enumerate(x)])
    sums = rows.groupBy("fold", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(x))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in range(len(x))]).collect()
    by = {(r["fold"], r["y"]): r for r in sums}
    d = range(len(x))
    parameters = []
    for g in range(k):
        total = sum(r["n"] for (h, _), r in by.items() if h != g)
        per_class = []
        for i, c in enumerate(classes):
            part = [r for (h, y), r in by.items() if h != g and y == c]
            n = sum(r["n"] for r in part)
            if not n:
                continue
            mean = [sum(r[f"s{j}"] for r in part) / n for j in d]
            var = [max(sum(r[f"q{j}"] for r in part) / n - mean[j] ** 2, 0.0) + floor or TINY for j in d]
            level = math.log(n / total) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in var)
            per_class.append((i, level, mean, [0.5 / v for v in var]))
        parameters.append((g, per_class))
    model = df.sparkSession.createDataFrame(
        parameters, "fold int, classes array<struct<i:int,level:double,mean:array<double>,half:array<double>>>")
    scored = rows.join(F.broadcast(model), "fold")
    xs = F.array(*[F.col(f"x{j}") for j in d])

    def score(c):
        squares = F.zip_with(xs, c["mean"], lambda v, m: (v - m) * (v - m))
        return c["level"] - F.aggregate(F.zip_with(squares, c["half"], lambda q, h: q * h), F.lit(0.0), lambda a, t: a + t)

    best = F.array_max(F.transform("classes", lambda c: F.struct(score(c), -c["i"])))
    names = F.array(*[F.lit(c) for c in classes])
    predictions = scored.select(
        "fold", (F.array_position(names, F.col("y")) - 1).cast("int").alias("y"), (-best["col2"]).alias("y_hat"))
    return _fold_scores(predictions)


# -- nearest neighbours ----------------------------------------------------------------------


def knn(
    df: DataFrame, key: str, features: Sequence[str] | str, target: str, k: int, neighbours: int = 1
) -> DataFrame:
    """Vote of the nearest training rows, features scaled inside each training fold.

    ``features`` are numeric columns, or the name of one array column.
    """
    if k < 2:
        return _unavailable(df, "fewer than two folds")
    return _fold_scores(knn_predictions(df, key, features, target, k, neighbours))


def knn_predictions(df, key, features, target, k, neighbours=1) -> DataFrame:
    if isinstance(features, str):
        width = df.select(F.size(features)).first()[0]
        values = [F.col(features)[i].cast("double") for i in range(width)]
    else:
        values = [clean(f) for f in features]
    names = [f"x{i}" for i in range(len(values))]
    rows = materialise(
        df.where(F.col(target).isNotNull()).select(key, target, "fold", *[v.alias(n) for v, n in zip(values, names)]), "knn")
    out = []
    for g in range(k):
        train = rows.where(F.col("fold") != g)
        facts = {r["feature"]: (r["m"] or 0.0, r["s"] or 1.0) for r in column_aggregates(
            train, names, lambda f: {"m": F.avg(f), "s": F.stddev_pop(f)}).collect()}
        scaled = [(F.coalesce(F.col(n), F.lit(facts[n][0])) - F.lit(facts[n][0])) / F.lit(facts[n][1]) for n in names]
        view = rows.select(key, target, "fold", F.array(*scaled).alias("vec"))
        near = nearest(view.where(F.col("fold") == g), view.where(F.col("fold") != g), neighbours, key, "vec")
        labels = rows.select(F.col(key).alias("neighbour"), F.col(target).alias("vote"))
        votes = near.join(labels, "neighbour").groupBy("query", "vote").agg(F.count(F.lit(1)).alias("n"))
        winner = votes.groupBy("query").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("y_hat"))
        truth = rows.where(F.col("fold") == g).select(F.col(key).alias("query"), F.col(target).alias("y"), "fold")
        out.append(truth.join(winner, "query"))
    return union_all(out)


# -- linear margin ---------------------------------------------------------------------------


def linear_svm(df: DataFrame, features: Sequence[str], target: str, k: int, max_iter: int = 2000) -> DataFrame:
    """One-vs-rest linear SVM on every row with a target, filled with medians and scaled inside each fold."""
    if k < 2:
        return _unavailable(df, "fewer than two folds")
    classes = class_list(df, target)
    names = F.array(*[F.lit(c) for c in classes])
    rows = materialise(
        df.where(F.col(target).isNotNull()).select(
            "fold", *[clean(f).alias(f) for f in features],
            (F.array_position(names, F.col(target)) - 1).cast("double").alias("label")), "svm")
    gaps = [r["feature"] for r in column_aggregates(
        rows, features, lambda f: {"n": F.count_if(F.col(f).isNull())}).collect() if r["n"]]
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw")
    out = []
    for g in range(k):
        known = column_quantiles(rows.where(F.col("fold") != g), gaps, [0.5]) if gaps else {}
        # A column without any value in the training fold says nothing: 0.
        filled = {f: F.coalesce(F.col(f), F.lit(known[f][0] if f in known else 0.0)) for f in gaps}
        whole = assembler.transform(rows.withColumns(filled) if gaps else rows).select("fold", "raw", "label")
        train, test = whole.where(F.col("fold") != g), whole.where(F.col("fold") == g)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        svm = LinearSVC(maxIter=max_iter, regParam=0.01)
        model = (svm if len(classes) == 2 else OneVsRest(classifier=svm)).fit(scaler.transform(train))
        out.append(model.transform(scaler.transform(test)).select(
            "fold", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("y_hat")))
    return _fold_scores(union_all(out))


def landmark_gap(linear: DataFrame, stump_scores: DataFrame) -> DataFrame:
    """Mean linear score minus mean stump score."""
    return linear.agg((F.avg("f1") - stump_scores.agg(F.avg("f1")).scalar()).alias("gap"))
