"""Classification, regression and curve metrics over a predictions table.

A predictions table has ``y``, ``y_hat`` and ``score`` (or ``proba``), plus any
grouping columns such as model and fold.  Class metrics all derive from the
confusion cells, one ``groupBy`` with map-side combine.  Curves collapse tied
scores first, so what has to be ordered is the distinct scores only, and that
order is distributed when there are many (see ``ordering.cumulative``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.scalars import ratio, sigmoid
from sondage.operators.profile import union_all
from sondage.plans.durable import materialise
from sondage.plans.ordering import SMALL_ROWS, cumulative

LOG_LOSS_EPS = 2.220446049250313e-16


def _one() -> Column:
    return F.count(F.lit(1))


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on the grouping columns; without any, ``right`` is a single row."""
    return left.join(right, list(by)) if by else left.join(F.broadcast(right), F.lit(True))


# -- confusion cells and what follows from them ----------------------------------------------


def cells(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "y", "y_hat").agg(_one().alias("n"))


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, y_hat, n) over all classes seen on either side, zeros kept: as many cells as the square of the classes."""
    counted = materialise(cells(predictions, by), "cells")
    seen = counted.select(F.explode(F.array("y", "y_hat")).alias("c")).distinct()
    classes = seen.agg(F.collect_list("c")).scalar()
    groups = counted.select(*by).distinct() if by else counted.agg(_one().alias("_k")).drop("_k")
    grid = groups.select(*by, F.explode(classes).alias("y")).select(*by, "y", F.explode(classes).alias("y_hat"))
    return grid.join(counted, [*by, "y", "y_hat"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_normalized(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row shares, and each cell relative to the largest one."""
    full = confusion_matrix(predictions, by)
    row, table = W.partitionBy(*by, "y"), W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return full.select(
        *by, "y", "y_hat", ratio(F.col("n"), F.sum("n").over(row)).alias("row_share"),
        ratio(F.col("n"), F.max("n").over(table)).alias("of_largest"),
    )


def per_class(predictions: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """(by..., class, support, tp, fp, fn, precision, recall, f)."""
    match = F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), match.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("y_hat").alias("class"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("predicted")),
    )
    sums = (
        cells(predictions, by).select(*by, F.inline(sides)).groupBy(*by, "class")
        .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    b2 = beta * beta
    f = ratio((1 + b2) * F.col("tp"), b2 * F.col("support") + F.col("predicted"))
    return sums.select(
        *by, "class", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f.alias("f"),
    )


def summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every scalar class metric in one row per group."""
    rows = per_class(predictions, by).withColumn("predicted", F.col("tp") + F.col("fp"))
    b2 = 4.0
    f2 = ratio((1 + b2) * F.col("tp"), b2 * F.col("support") + F.col("predicted"))
    n = F.sum("support").cast("double")

    def weighted(c):
        return ratio(F.sum(c * F.col("support")), F.sum("support"))

    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))
    right = F.sum("tp").cast("double")
    expected = pt / (n * n)
    group = rows.groupBy(*by)
    micro = ratio(F.sum("tp"), F.sum("support"))
    return group.agg(
        F.sum("support").alias("n"),
        micro.alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f").alias("f1_macro"),
        micro.alias("precision_micro"), micro.alias("recall_micro"), micro.alias("f1_micro"),
        weighted(F.col("precision")).alias("precision_weighted"), weighted(F.col("recall")).alias("recall_weighted"),
        weighted(F.col("f")).alias("f1_weighted"), weighted(f2).alias("f2_weighted"),
        F.coalesce(F.try_divide(right * n - pt, F.sqrt((n * n - pp) * (n * n - tt))), F.lit(0.0)).alias("mcc"),
        F.coalesce(F.try_divide(right / n - expected, 1.0 - expected), F.lit(0.0)).alias("kappa"),
    )


def fbeta(predictions: DataFrame, beta: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    rows = per_class(predictions, by, beta)
    return rows.groupBy(*by).agg(ratio(F.sum(F.col("f") * F.col("support")), F.sum("support")).alias("fbeta"))


def classification_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per class, then the macro and support-weighted averages."""
    rows = per_class(predictions, by)
    total = F.sum("support")
    names = ["precision", "recall", "f"]
    macro = rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = rows.groupBy(*by).agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("support")
    )
    return union_all([
        rows.select(*by, F.col("class").cast("string").alias("label"), *names, "support"),
        macro.withColumn("label", F.lit("macro avg")), weighted.withColumn("label", F.lit("weighted avg")),
    ])


# -- curves ----------------------------------------------------------------------------------


def score_steps(
    predictions: DataFrame, by: Sequence[str] = (), score: str = "score", positive: Column | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Per distinct score, from the highest: own (pos, neg) and running (tp, fp), with totals (p, n)."""
    hit = positive if positive is not None else F.col("y") == 1
    collapsed = predictions.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    steps = cumulative(collapsed, [F.col("threshold").desc()], by, {"tp": "pos", "fp": "neg"}, small_rows=small_rows)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return _join(steps, totals, by)


def roc_curve(predictions: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """(by..., threshold, fpr, tpr), one point per distinct threshold plus the origin (null threshold)."""
    steps = score_steps(predictions, by, **kw)
    points = steps.select(
        *by, "threshold", ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr")
    )
    groups = steps.groupBy(*by).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return union_all([points, groups.withColumn("threshold", F.lit(None).cast("double"))])


def roc_auc(predictions: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Trapezoid area; each tied score adds neg * (tp before + pos / 2)."""
    steps = score_steps(predictions, by, **kw)
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return steps.groupBy(*by).agg(
        F.try_divide(area, F.first("p").cast("double") * F.first("n")).alias("roc_auc"), F.first("p").alias("positives")
    )


def explode_proba(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest rows (by..., class, y, score) from ``proba``."""
    return predictions.select(*by, F.col("y").alias("_y"), F.posexplode("proba").alias("class", "score")).select(
        *by, "class", (F.col("_y") == F.col("class")).cast("int").alias("y"), "score"
    )


def roc_auc_ovr(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    area = roc_auc(explode_proba(predictions, by), [*by, "class"])
    weighted = F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum(F.when(F.col("roc_auc").isNotNull(), F.col("positives"))))
    return area.groupBy(*by).agg(F.avg("roc_auc").alias("auc_macro"), weighted.alias("auc_weighted"))


def roc_macro_average(predictions: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(fpr, tpr): each class's ROC interpolated on the union of all fprs, then averaged.

    Along fpr a class's curve never falls, so the known point at or before a grid
    value is a running maximum, and the one after it a running maximum of the
    negated values in reverse.  Both run distributed on long curves.
    """
    curve = roc_curve(explode_proba(predictions), ["class"], small_rows=small_rows)
    # np.interp semantics at a vertical step: arrive at its bottom, leave from its top.
    points = materialise(
        curve.groupBy("class", "fpr").agg(F.min("tpr").alias("bottom"), F.max("tpr").alias("top")), "roc"
    )
    grid = points.select("fpr").distinct()
    classes = points.select("class").distinct()
    # Every class gets every grid value: that is the size of the averaged result's input.
    frame = grid.select("fpr", F.explode(classes.agg(F.collect_list("class")).scalar()).alias("class"))
    known = frame.join(points, ["class", "fpr"], "left").select(
        "class", "fpr", "bottom", "top", F.when(F.col("top").isNotNull(), F.col("fpr")).alias("at"),
        (-F.when(F.col("top").isNotNull(), F.col("fpr"))).alias("neg_at"), (-F.col("bottom")).alias("neg_bottom"),
    )
    back = cumulative(known, ["fpr"], ["class"], maxima={"x0": "at", "y0": "top"}, small_rows=small_rows)
    both = cumulative(back, [F.col("fpr").desc()], ["class"], maxima={"nx1": "neg_at", "ny1": "neg_bottom"},
                      small_rows=small_rows)
    x1, y1 = -F.col("nx1"), -F.col("ny1")
    slope = F.coalesce(F.try_divide(y1 - F.col("y0"), x1 - F.col("x0")), F.lit(0.0))
    value = F.when(F.col("top").isNotNull(), F.col("top")).otherwise(
        F.coalesce(F.col("y0") + (F.col("fpr") - F.col("x0")) * slope, F.col("y0"))
    )
    return both.groupBy("fpr").agg(F.avg(value).alias("tpr"))


def pr_curve(predictions: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """(by..., threshold, precision, recall) per distinct threshold, plus the end (1, 0)."""
    steps = score_steps(predictions, by, **kw)
    points = steps.select(
        *by, "threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
    )
    end = steps.groupBy(*by).agg(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return union_all([points, end.withColumn("threshold", F.lit(None).cast("double"))])


def pr_auc(predictions: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Trapezoid area and the prevalence baseline.  A step knows its predecessor:
    running counts minus its own."""
    steps = score_steps(predictions, by, **kw)
    seen = F.col("tp") + F.col("fp")
    before_tp, before = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    precision = ratio(F.col("tp"), seen)
    previous = F.coalesce(F.try_divide(before_tp.cast("double"), before.cast("double")), F.lit(1.0))
    area = F.sum(ratio(F.col("pos"), F.col("p")) * (precision + previous) / 2)
    return steps.groupBy(*by).agg(
        area.alias("pr_auc"), ratio(F.first("p"), F.first("p") + F.first("n")).alias("baseline")
    )


def log_loss_brier(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))
    return predictions.groupBy(*by).agg(
        F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier")
    )


def calibration_curve(predictions: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by..., bin, mean_score, positive_share, n) of the non-empty bins."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return predictions.groupBy(*by, place.alias("bin")).agg(
        F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_share"), _one().alias("n")
    )


def threshold_sweep(predictions: DataFrame, by: Sequence[str] = (), steps: int = 50) -> DataFrame:
    """Accuracy at ``steps`` even thresholds from 0 to 1 in one pass, the first best one marked."""
    thresholds = [i / (steps - 1) for i in range(steps)]
    hits = [
        F.struct(
            F.lit(i).alias("step"), F.lit(t).alias("threshold"),
            F.avg(((F.col("score") >= t) == (F.col("y") == 1)).cast("double")).alias("accuracy"),
        )
        for i, t in enumerate(thresholds)
    ]
    rows = predictions.groupBy(*by).agg(F.array(*hits).alias("h"))
    best = F.array_max(F.transform("h", lambda s: F.struct(s["accuracy"], -s["step"])))
    return rows.select(*by, F.inline("h"), (-best["col2"]).alias("_best")).select(
        *by, "threshold", "accuracy", (F.col("step") == F.col("_best")).alias("is_best")
    )


def confidence_hist(predictions: DataFrame, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Histogram of the winning probability over [0, 1], by right and wrong."""
    confidence = F.greatest(F.col("score"), F.lit(1.0) - F.col("score"))
    place = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("long")
    right = (F.col("y") == F.col("y_hat")).alias("correct")
    return predictions.groupBy(*by, right, place.alias("bin")).agg(_one().alias("n"))


# -- regression ------------------------------------------------------------------------------


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    sse = F.sum(error * error)
    sst = F.var_pop("actual") * F.count("actual")
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
    )


def residuals(predictions: DataFrame, key: str, rows: int | None = 200) -> DataFrame:
    out = predictions.select(key, "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("residual"))
    return out.orderBy(key).limit(rows) if rows else out


def ols_trend(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.regr_slope("predicted", "actual").alias("slope"), F.regr_intercept("predicted", "actual").alias("intercept")
    )


# -- model tables ----------------------------------------------------------------------------


def cv_summary(predictions: DataFrame, metrics: Sequence[str] = ("accuracy", "f1_weighted")) -> DataFrame:
    """Mean and population deviation over folds, and the fold scores in order."""
    folds = summary(predictions, ["model", "fold"])
    out = []
    for m in metrics:
        scores = F.transform(F.array_sort(F.collect_list(F.struct("fold", m))), lambda s: s[m])
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), scores.alias(f"{m}_folds")]
    return folds.groupBy("model").agg(*out)


def leaderboard(metrics: DataFrame, model: str = "model", score: str = "f1_weighted") -> DataFrame:
    """Metrics with a rank by descending score.  One row per model, so one small window."""
    return metrics.withColumn("rank", F.rank().over(W.orderBy(F.col(score).desc())))


def metrics_compare(
    metrics: DataFrame, models: Sequence, names: Sequence[str], model: str = "model"
) -> DataFrame:
    """(model, metric, value) for chosen models and metrics; missing values as 0."""
    chosen = metrics.where(F.col(model).isin(list(models)))
    filled = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    return chosen.select(model, *filled).unpivot([model], list(names), "metric", "value")


def best_model(metrics: DataFrame, score: str, order: str = "model") -> DataFrame:
    """The row with the highest score, the first by ``order`` on ties."""
    names = metrics.columns
    best = metrics.agg(F.min_by(F.struct(*names), F.struct(-F.col(score), F.col(order))).alias("b"))
    return best.select("b.*")


def decision_to_proba(df: DataFrame, margin: str, out: str = "score") -> DataFrame:
    return df.withColumn(out, sigmoid(F.col(margin)))
