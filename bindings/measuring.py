"""Metrics over predictions."""

from pyspark.sql import functions as F

from bindings.profiling import rounded
from bindings.registry import query
from bindings.tables import PRED, PRED5, REG
from sondage.operators import metrics as m

PER_CLASS5 = f"""{PRED5}, cl AS (SELECT unnest(range(5))::INT AS class),
 pc AS (SELECT class, count_if(y = class)::BIGINT AS support, count_if(y = class AND y_hat = class)::BIGINT AS tp,
   count_if(y <> class AND y_hat = class)::BIGINT AS fp, count_if(y = class AND y_hat <> class)::BIGINT AS fn
   FROM pred5, cl GROUP BY 1),
 prf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r,
   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f,
   coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0)::DOUBLE, 0) AS f2 FROM pc)"""


@query("confusion_matrix", f"""WITH {PRED}, g AS (SELECT DISTINCT model FROM pred), c AS (SELECT unnest([0, 1])::INT AS c)
  SELECT g.model, a.c AS y, b.c AS y_hat, count(pred.y) AS n FROM g, c a, c b LEFT JOIN pred
  ON pred.model = g.model AND pred.y = a.c AND pred.y_hat = b.c GROUP BY ALL""")
def _(t):
    return m.confusion_matrix(t.pred(), ["model"])


@query("confusion_normalized", f"""WITH {PRED5}, c AS (SELECT y, y_hat, count(*) AS n FROM pred5 GROUP BY ALL),
  k AS (SELECT unnest(range(5))::INT AS k), f AS (SELECT a.k AS y, b.k AS y_hat, coalesce(n, 0) AS n FROM k a, k b
    LEFT JOIN c ON c.y = a.k AND c.y_hat = b.k)
  SELECT y, y_hat, round(n / sum(n) OVER (PARTITION BY y)::DOUBLE, 6) AS row_share, round(n / (max(n) OVER ())::DOUBLE, 6) AS of_largest FROM f""")
def _(t):
    return rounded(m.confusion_normalized(t.pred5()), 6, "row_share", "of_largest")


@query("accuracy_balanced", f"""WITH {PRED} SELECT model, round(avg((y = y_hat)::INT), 6) AS accuracy,
  round((avg(CASE WHEN y = 1 THEN y_hat END) + avg(CASE WHEN y = 0 THEN 1 - y_hat END)) / 2, 6) AS balanced_accuracy FROM pred GROUP BY 1""")
def _(t):
    return rounded(m.summary(t.pred(), ["model"]).select("model", "accuracy", "balanced_accuracy"), 6, "accuracy", "balanced_accuracy")


@query("prf_macro_micro_weighted", f"""WITH {PER_CLASS5} SELECT round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
  round(avg(f), 6) AS f1_macro, round(sum(tp) / sum(support)::DOUBLE, 6) AS precision_micro, round(sum(tp) / sum(support)::DOUBLE, 6) AS recall_micro,
  round(sum(tp) / sum(support)::DOUBLE, 6) AS f1_micro, round(sum(p * support) / sum(support), 6) AS precision_weighted,
  round(sum(r * support) / sum(support), 6) AS recall_weighted, round(sum(f * support) / sum(support), 6) AS f1_weighted FROM prf""")
def _(t):
    names = [f"{k}_{a}" for a in ("macro", "micro", "weighted") for k in ("precision", "recall", "f1")]
    return rounded(m.summary(t.pred5()).select(*names), 6, *names)


@query("fbeta", f"WITH {PER_CLASS5} SELECT round(sum(f2 * support) / sum(support), 6) AS fbeta FROM prf")
def _(t):
    return rounded(m.fbeta(t.pred5(), 2.0), 6, "fbeta")


MARGINS = """mg AS (SELECT sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS c, sum(support::DOUBLE * (tp + fp)) AS pt,
  sum((tp + fp)::DOUBLE * (tp + fp)) AS pp, sum(support::DOUBLE * support) AS tt FROM pc)"""


@query("mcc", f"WITH {PER_CLASS5}, {MARGINS} SELECT round((c * n - pt) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc FROM mg")
def _(t):
    return rounded(m.summary(t.pred5()).select("mcc"), 6, "mcc")


@query("cohen_kappa", f"WITH {PER_CLASS5}, {MARGINS} SELECT round((c / n - pt / (n * n)) / (1 - pt / (n * n)), 6) AS kappa FROM mg")
def _(t):
    return rounded(m.summary(t.pred5()).select("kappa"), 6, "kappa")


@query("classification_report", f"""WITH {PER_CLASS5} SELECT class::VARCHAR AS label, round(p, 6) AS precision, round(r, 6) AS recall,
   round(f, 6) AS f, support FROM prf
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM prf
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
   round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM prf""")
def _(t):
    return rounded(m.classification_report(t.pred5()), 6, "precision", "recall", "f")


@query("per_class", f"WITH {PER_CLASS5} SELECT class, support, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM prf")
def _(t):
    return rounded(m.per_class(t.pred5()), 6, "precision", "recall", "f")


def steps_sql(source, key):
    return f"""st AS (SELECT {key}, score, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM {source} GROUP BY ALL),
 cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {key}) AS p, sum(neg) OVER (PARTITION BY {key}) AS n
   FROM st WINDOW w AS (PARTITION BY {key} ORDER BY score DESC))"""


@query("roc_curve", f"""WITH {PRED}, {steps_sql('pred', 'model')} SELECT model, score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cu
  UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM cu""")
def _(t):
    return rounded(m.roc_curve(t.pred(), ["model"]), 6, "fpr", "tpr")


AUC_RANKS = """SELECT {key}, (sum(CASE WHEN y = 1 THEN rk END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc,
  sum(y)::BIGINT AS positives FROM (SELECT {key}, y, rank() OVER (PARTITION BY {key} ORDER BY score)
   + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0::DOUBLE AS rk FROM {source}) GROUP BY 1"""


@query("roc_auc", f"WITH {PRED} SELECT model, round(auc, 6) AS roc_auc, positives FROM ({AUC_RANKS.format(key='model', source='pred')})")
def _(t):
    return rounded(m.roc_auc(t.pred(), ["model"]), 6, "roc_auc")


@query("roc_auc_ovr", f"""WITH {PRED5} SELECT round(avg(auc), 6) AS auc_macro, round(sum(auc * positives) / sum(positives), 6) AS auc_weighted
  FROM ({AUC_RANKS.format(key='class', source='ovr')})""")
def _(t):
    return rounded(m.roc_auc_ovr(t.pred5()), 6, "auc_macro", "auc_weighted")


@query("roc_macro_average", f"""WITH {PRED5}, {steps_sql('ovr', 'class')}, roc AS (SELECT class, fp / n AS fpr, tp / p AS tpr FROM cu
   UNION ALL SELECT DISTINCT class, 0, 0 FROM cu), pts AS (SELECT class, fpr, min(tpr) AS bottom, max(tpr) AS top FROM roc GROUP BY ALL),
  g AS (SELECT * FROM (SELECT DISTINCT fpr FROM pts), (SELECT DISTINCT class FROM pts)),
  lo AS (SELECT g.class, g.fpr, p.fpr AS x0, p.top AS y0 FROM g ASOF JOIN pts p ON g.class = p.class AND g.fpr >= p.fpr),
  hi AS (SELECT lo.*, p.fpr AS x1, p.bottom AS y1 FROM lo ASOF LEFT JOIN pts p ON lo.class = p.class AND lo.fpr <= p.fpr)
  SELECT round(fpr, 6) AS fpr, round(avg(CASE WHEN x0 = fpr OR x1 IS NULL THEN y0 ELSE y0 + (fpr - x0) * (y1 - y0) / (x1 - x0) END), 5) AS tpr
  FROM hi GROUP BY hi.fpr""")
def _(t):
    return m.roc_macro_average(t.pred5()).select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 5).alias("tpr"))


@query("pr_curve", f"""WITH {PRED}, {steps_sql('pred', 'model')} SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM cu
  UNION ALL SELECT DISTINCT model, NULL, 1, 0 FROM cu""")
def _(t):
    return rounded(m.pr_curve(t.pred(), ["model"]), 6, "precision", "recall")


@query("pr_curve_auc", f"""WITH {PRED}, {steps_sql('pred', 'model')}, pt AS (SELECT model, tp / (tp + fp) AS pr, tp / p AS rc, p, n, score FROM cu),
  lg AS (SELECT *, coalesce(lag(pr) OVER w, 1) AS pr0, coalesce(lag(rc) OVER w, 0) AS rc0 FROM pt WINDOW w AS (PARTITION BY model ORDER BY score DESC))
  SELECT model, round(sum((rc - rc0) * (pr + pr0) / 2), 6) AS pr_auc, round(any_value(p / (p + n)), 6) AS baseline FROM lg GROUP BY 1""")
def _(t):
    return rounded(m.pr_auc(t.pred(), ["model"]), 6, "pr_auc", "baseline")


@query("log_loss_brier", f"""WITH {PRED}, c AS (SELECT *, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM pred)
  SELECT model, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss, round(avg(pow(score - y, 2)), 6) AS brier FROM c GROUP BY 1""")
def _(t):
    return rounded(m.log_loss_brier(t.pred(), ["model"]), 6, "log_loss", "brier")


@query("calibration_curve", f"""WITH {PRED} SELECT model, least(floor(score * 10), 9)::BIGINT AS bin, round(avg(score), 6) AS mean_score,
  round(avg(y), 6) AS positive_share, count(*) AS n FROM pred GROUP BY 1, 2""")
def _(t):
    return rounded(m.calibration_curve(t.pred(), ["model"]), 6, "mean_score", "positive_share")


@query("threshold_sweep", f"""WITH {PRED}, th AS (SELECT i, i / 49.0::DOUBLE AS threshold FROM (SELECT unnest(range(50)) AS i)),
  a AS (SELECT model, i, threshold, avg(((score >= threshold) = (y = 1))::INT) AS accuracy FROM pred, th GROUP BY ALL)
  SELECT model, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy,
   row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, i) = 1 AS is_best FROM a""")
def _(t):
    return rounded(m.threshold_sweep(t.pred(), ["model"]), 6, "threshold", "accuracy")


@query("confidence_hist", f"""WITH {PRED} SELECT model, y = y_hat AS correct, least(floor(greatest(score, 1.0::DOUBLE - score) * 20), 19)::BIGINT AS bin,
  count(*) AS n FROM pred GROUP BY ALL""")
def _(t):
    return m.confidence_hist(t.pred(), ["model"])


@query("regression_metrics", f"""WITH {REG} SELECT round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse, round(avg(abs(actual - predicted)), 4) AS mae,
  round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)), 6) AS r2 FROM reg""")
def _(t):
    return rounded(rounded(m.regression_metrics(t.reg()), 4, "rmse", "mae"), 6, "r2")


@query("residuals", f"""WITH {REG} SELECT row_id, actual, round(predicted, 4) AS predicted, round(actual - predicted, 4) AS residual FROM reg ORDER BY row_id LIMIT 200""")
def _(t):
    return rounded(m.residuals(t.reg(), "row_id"), 4, "predicted", "residual")


@query("residual_hist", f"""WITH {REG}, e AS (SELECT actual - predicted AS residual FROM reg), r AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 30 AS w FROM e),
  c AS (SELECT least(floor((residual - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM e, r GROUP BY 1)
  SELECT g.bin, round(lo + w * g.bin, 4) AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin""")
def _(t):
    from sondage.operators.profile import histogram

    hist = histogram(m.residuals(t.reg(), "row_id", rows=None), ["residual"], 30, fixed=True)
    return rounded(hist.select("bin", "low", "n"), 4, "low")


@query("ols_trend", f"WITH {REG} SELECT round(regr_slope(predicted, actual), 6) AS slope, round(regr_intercept(predicted, actual), 4) AS intercept FROM reg")
def _(t):
    return rounded(rounded(m.ols_trend(t.reg()), 6, "slope"), 4, "intercept")


FOLDS = """fd AS (SELECT model, fold, avg((y = y_hat)::INT) AS accuracy,
   avg((y = 1)::INT) * coalesce(2 * count_if(y = 1 AND y_hat = 1) / nullif(2 * count_if(y = 1 AND y_hat = 1) + count_if(y <> y_hat), 0)::DOUBLE, 0)
   + avg((y = 0)::INT) * coalesce(2 * count_if(y = 0 AND y_hat = 0) / nullif(2 * count_if(y = 0 AND y_hat = 0) + count_if(y <> y_hat), 0)::DOUBLE, 0) AS f1 FROM pred GROUP BY ALL)"""


@query("cv_summary", f"""WITH {PRED}, {FOLDS} SELECT model, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
  round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM fd GROUP BY 1""")
def _(t):
    out = m.cv_summary(t.pred())
    return out.select(
        "model", F.round("accuracy_mean", 6).alias("accuracy_mean"), F.round("accuracy_std", 6).alias("accuracy_std"),
        F.round("f1_weighted_mean", 6).alias("f1_mean"), F.round("f1_weighted_std", 6).alias("f1_std"))


BOARD = f"""{PRED}, {FOLDS.replace('fold, avg', 'avg').replace('fd AS', 'bd AS')}"""


@query("leaderboard", f"""WITH {BOARD} SELECT model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1_weighted, (rank() OVER (ORDER BY f1 DESC))::INT AS rank FROM bd""")
def _(t):
    board = m.leaderboard(m.summary(t.pred(), ["model"]).select("model", "accuracy", "f1_weighted"))
    return rounded(board, 6, "accuracy", "f1_weighted")


@query("metrics_compare", f"""WITH {BOARD} SELECT model, metric, round(value, 6) AS value FROM
  (UNPIVOT (SELECT model, accuracy, f1 AS f1_weighted FROM bd WHERE model IN (0, 2)) ON accuracy, f1_weighted INTO NAME metric VALUE value)""")
def _(t):
    return rounded(m.metrics_compare(m.summary(t.pred(), ["model"]), [0, 2], ["accuracy", "f1_weighted"]), 6, "value")


@query("best_model", f"WITH {BOARD} SELECT model, round(f1, 6) AS f1_weighted FROM bd ORDER BY f1 DESC, model LIMIT 1")
def _(t):
    best = m.best_model(m.summary(t.pred(), ["model"]).select("model", "f1_weighted"), "f1_weighted")
    return rounded(best, 6, "f1_weighted")


@query("compare_top_n", f"WITH {BOARD} SELECT model, round(f1, 6) AS f1_weighted FROM bd ORDER BY f1 DESC, model LIMIT 2")
def _(t):
    board = m.summary(t.pred(), ["model"]).select("model", "f1_weighted")
    return rounded(board.orderBy(F.col("f1_weighted").desc(), "model").limit(2), 6, "f1_weighted")


@query("evaluate_model", f"""WITH {PRED}, {FOLDS.replace('model, fold, avg', 'avg').replace('GROUP BY ALL', '')},
  a AS ({AUC_RANKS.format(key='one', source='(SELECT *, 1 AS one FROM pred)')})
  SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(auc, 6) AS roc_auc FROM fd, a""")
def _(t):
    from sondage.operators.training import evaluate

    out = evaluate(t.pred()).select("accuracy", "f1", "roc_auc")
    return rounded(out, 6, "accuracy", "f1", "roc_auc")


@query("evaluate_regression", f"""WITH {REG} SELECT round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse,
  round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)), 6) AS r2 FROM reg""")
def _(t):
    from sondage.operators.training import evaluate

    out = evaluate(t.reg(), "regression").select("rmse", "r2")
    return rounded(rounded(out, 4, "rmse"), 6, "r2")


@query("decision_to_proba", "SELECT event_id, round(1 / (1 + exp(-((value - 50) / 25.0::DOUBLE))), 6) AS score FROM events")
def _(t):
    df = t.events.select("event_id", ((F.col("value") - 50.0) / F.lit(25.0)).alias("margin"))
    return rounded(m.decision_to_proba(df, "margin").drop("margin"), 6, "score")
