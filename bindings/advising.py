"""Quality advice."""

from pyspark.sql import functions as F

from bindings.profiling import EVENT_FEATURES, EVENT_LONG, MI, MISSING, MOMENTS, CORR, mi_sql, rounded
from bindings.registry import query
from bindings.tables import CONST, DOC, EVENT, LINE, LINE_FEATURES, LINE_LONG, NULLS, PRED
from sondage.operators import advise, information, metrics, profile

SHOWN = ["feature", "issue_type", "severity", "metric_value", "threshold", "action", "recommended_transform"]


def issue_sql(feature, kind, severity, metric, threshold, action, tail, transform="NULL"):
    return f"""SELECT {feature} AS feature, {kind} AS issue_type, {severity} AS severity, {metric} AS metric_value,
  {threshold}::DOUBLE AS threshold, {action} AS action, {transform}::VARCHAR AS recommended_transform {tail}"""


ZERO = issue_sql("feature", "'weak_near_zero_variance'", "'high'", "round(var_pop, 6)", 0.01,
                 "printf('Remove feature \"%s\" - near-zero variance (%.6f) indicates no discriminative power', feature, var_pop)",
                 "FROM mom WHERE var_pop < 0.01")
LOW = issue_sql("feature", "'weak_low_mutual_info'", "'medium'", "round(mi, 4)", 0.01,
                "printf('Consider removing or transforming \"%s\" - very low mutual information (%.4f) with target', feature, mi)",
                "FROM mi WHERE mi < 0.01")
PAIRS = issue_sql(
    "CASE WHEN x.mi >= z.mi THEN a || '/' || b ELSE b || '/' || a END", "'redundant_high_correlation'", "'high'", "round(abs(corr), 4)", 0.92,
    """printf('Features "%s" and "%s" are highly correlated (%.2f%%). Keep "%s" (MI=%.4f), remove "%s"', a, b, abs(corr) * 100,
     CASE WHEN x.mi >= z.mi THEN a ELSE b END, greatest(x.mi, z.mi), CASE WHEN x.mi >= z.mi THEN b ELSE a END)""",
    f"FROM corr JOIN mi x ON a = x.feature JOIN mi z ON b = z.feature WHERE abs(corr) > 0.92 AND list_position({LINE_FEATURES}, a) < list_position({LINE_FEATURES}, b)")
SKEW = issue_sql(
    "feature", "'highly_skewed'", "'medium'", "round(skewness, 4)", 1.5,
    """CASE WHEN low >= 0 THEN printf('Apply log1p transformation to "%s" - highly skewed (skewness=%.2f)', feature, skewness)
     ELSE printf('Apply Box-Cox or Yeo-Johnson transformation to "%s" - highly skewed (skewness=%.2f)', feature, skewness) END""",
    "FROM mom JOIN (SELECT feature, min(value) AS low FROM long GROUP BY 1) USING (feature) WHERE n > 3 AND abs(skewness) > 1.5",
    "CASE WHEN low >= 0 THEN 'log1p' ELSE 'Box-Cox' END")
MISS = issue_sql(
    "feature", "CASE WHEN share > 0.3 THEN 'high_missing' ELSE 'moderate_missing' END", "CASE WHEN share > 0.3 THEN 'high' ELSE 'low' END",
    "round(share * 100, 2)", 30,
    """CASE WHEN share > 0.3 THEN printf('Consider removing column "%s" - %.1f%% missing values exceeds 30%% threshold', feature, share * 100)
     ELSE printf('Impute "%s" using %s imputation - %.1f%% missing values', feature, CASE WHEN feature = 'priority' THEN 'mode' ELSE 'median' END, share * 100) END""",
    "FROM miss WHERE missing > 0")
MISSING_EXACT = MISSING.replace("round((", "((").replace("::DOUBLE, 6)", "::DOUBLE)")
BALANCE = issue_sql(
    "'target'", "CASE WHEN r > 10 THEN 'class_imbalance' ELSE 'moderate_imbalance' END", "CASE WHEN r > 10 THEN 'high' ELSE 'medium' END",
    "round(r, 2)", "CASE WHEN r > 10 THEN 10 ELSE 5 END",
    """CASE WHEN r > 10 THEN printf('Class imbalance detected (ratio=%.1f). Consider SMOTE oversampling, class weighting, or threshold adjustment', r)
     ELSE printf('Moderate class imbalance (ratio=%.1f). Consider class_weight="balanced" in your model', r) END""",
    "FROM (SELECT max(n) / min(n)::DOUBLE AS r FROM (SELECT {y} AS y, count(*) AS n FROM {t} GROUP BY 1)) WHERE r > 5")


@query("near_zero_variance", f"""WITH {CONST}, long AS (SELECT 'p_size' AS feature, p_size::DOUBLE AS value FROM const UNION ALL
  SELECT 'p_retailprice', p_retailprice FROM const UNION ALL SELECT 'constant_feature', constant_feature FROM const),
  mom AS (SELECT feature, var_pop(value) AS var_pop FROM long GROUP BY 1) {ZERO}""")
def _(t):
    return advise.near_zero_variance(profile.moments(t.const(), ["p_size", "p_retailprice", "constant_feature"]))


@query("low_mutual_info", f"WITH {EVENT_LONG}, {mi_sql('long')}, {MI} {LOW}")
def _(t):
    return advise.low_information(information.mutual_information(t.event(), EVENT_FEATURES, "event_type"))


@query("redundant_pairs", f"WITH {LINE_LONG}, {mi_sql('long')}, {MI}, {CORR} {PAIRS}")
def _(t):
    line = t.line()
    return advise.redundant_pairs(
        profile.correlations(line, LINE_FEATURES), information.mutual_information(line, LINE_FEATURES, "l_returnflag"))


@query("skewed_features", f"WITH {EVENT_LONG}, {MOMENTS} {SKEW}")
def _(t):
    return advise.skewed_features(profile.moments(t.event(), EVENT_FEATURES))


@query("missing_issues", f"WITH {MISSING_EXACT} {MISS}")
def _(t):
    return advise.missing_issues(profile.missing_by_column(t.null()), ["o_orderkey", "o_custkey", "price"])


@query("imbalance_issue", f"WITH {DOC} {BALANCE.format(y='quality', t='doc')}")
def _(t):
    return advise.imbalance_issue(t.doc(), "quality")


# ------------------------------------------------------------------------------------------------
ADVICE = f"""{NULLS}, base AS (SELECT price, o_custkey::DOUBLE AS o_custkey, 1.0::DOUBLE AS one, priority, o_orderstatus FROM nulls),
 med AS (SELECT median(price) AS m FROM base),
 long AS (SELECT 'price' AS feature, coalesce(price, m) AS value, o_orderstatus AS y FROM base, med UNION ALL
   SELECT 'o_custkey', o_custkey, o_orderstatus FROM base UNION ALL SELECT 'one', one, o_orderstatus FROM base),
 miss AS (SELECT 'price' AS feature, count(*) - count(price) AS missing, (count(*) - count(price)) / count(*)::DOUBLE AS share FROM base
   UNION ALL SELECT 'priority', count(*) - count(priority), (count(*) - count(priority)) / count(*)::DOUBLE FROM base),
 {MOMENTS}, {mi_sql('long')}, {MI},
 issues AS ({ZERO} UNION ALL {LOW} UNION ALL {SKEW} UNION ALL {MISS} UNION ALL {BALANCE.format(y='o_orderstatus', t='base')})"""


def _advice(t):
    df = t.null().select("price", F.col("o_custkey").cast("double"), F.lit(1.0).alias("one"), "priority", "o_orderstatus")
    return advise.advise(df, "o_orderstatus")


@query("advise", f"WITH {ADVICE} SELECT * FROM issues")
def _(t):
    return _advice(t).select(*SHOWN)


@query("health_summary", f"""WITH {ADVICE}, c AS (SELECT count(*) AS t, count_if(severity = 'high')::BIGINT AS h, count_if(severity = 'medium')::BIGINT AS m,
   count_if(severity = 'low')::BIGINT AS l FROM issues)
  SELECT CASE WHEN h > 0 THEN 'critical' WHEN m > 0 THEN 'warning' WHEN t > 0 THEN 'minor' ELSE 'healthy' END AS status, t AS total_issues,
   h AS high_severity, m AS medium_severity, l AS low_severity,
   (SELECT string_agg(issue_type || '=' || n, ',' ORDER BY issue_type) FROM (SELECT issue_type, count(*) AS n FROM issues GROUP BY 1)) AS issue_types,
   printf('Found %d high, %d medium, and %d low severity issues.', h, m, l) AS summary FROM c""")
def _(t):
    out = advise.health_summary(_advice(t))
    pairs = F.transform(F.array_sort(F.map_entries("issue_types")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("issue_types", F.array_join(pairs, ","))


@query("preprocessing_tips", f"""WITH {ADVICE} SELECT feature, issue_type, CASE issue_type
   WHEN 'high_missing' THEN 'Consider removing columns with >30% missing values' WHEN 'highly_skewed' THEN 'Apply log or Box-Cox transformation'
   WHEN 'weak_near_zero_variance' THEN 'Remove features with near-zero variance' WHEN 'redundant_high_correlation' THEN 'Remove one of highly correlated feature pairs'
   WHEN 'class_imbalance' THEN 'Use SMOTE, class weighting, or adjust decision threshold' END AS tip FROM issues
  WHERE issue_type IN ('high_missing', 'highly_skewed', 'weak_near_zero_variance', 'redundant_high_correlation', 'class_imbalance')""")
def _(t):
    return advise.preprocessing_tips(_advice(t))


@query("improvement_suggestions", f"""WITH {NULLS}, {PRED}, f AS (SELECT avg((y = 1)::INT) * 2 * count_if(y = 1 AND y_hat = 1) / (2 * count_if(y = 1 AND y_hat = 1) + count_if(y <> y_hat))::DOUBLE
    + avg((y = 0)::INT) * 2 * count_if(y = 0 AND y_hat = 0) / (2 * count_if(y = 0 AND y_hat = 0) + count_if(y <> y_hat))::DOUBLE AS f1 FROM pred),
  r AS (SELECT max(n) / min(n)::DOUBLE AS r FROM (SELECT o_orderstatus, count(*) AS n FROM nulls GROUP BY 1)),
  s AS (SELECT abs(skewness(price) * (count(price) - 2) / sqrt(count(price) * (count(price) - 1.0))) AS s FROM nulls)
  SELECT 1 AS position, 'Clean missing values in: priority, price. Use median/mode imputation or model-aware imputation.' AS suggestion
  UNION ALL SELECT 2, 'Apply log/Yeo-Johnson transforms to skewed features: price.' FROM s WHERE s > 1.5
  UNION ALL SELECT 3, 'Class imbalance detected. Try class weights, SMOTE, or threshold tuning.' FROM r WHERE r > 3
  UNION ALL SELECT 4, CASE WHEN f1 < 0.75 THEN 'F1 is below 0.75. Add domain features, remove leakage/noise, tune hyperparameters, and check labeling quality.'
    ELSE 'Performance is strong. Run repeated cross-validation and calibration before deployment.' END FROM f
  UNION ALL SELECT 5, 'Export the best model only after checking learning curves, feature importance, and data drift across versions.'""")
def _(t):
    best = metrics.summary(t.pred()).select("f1_weighted").scalar()
    return advise.improvement_suggestions(t.null(), "o_orderstatus", "classification", best)


@query("what_if", f"""WITH {PRED}, f AS (SELECT count(*) AS n, avg((y = 1)::INT) * 2 * count_if(y = 1 AND y_hat = 1) / (2 * count_if(y = 1 AND y_hat = 1) + count_if(y <> y_hat))::DOUBLE
    + avg((y = 0)::INT) * 2 * count_if(y = 0 AND y_hat = 0) / (2 * count_if(y = 0 AND y_hat = 0) + count_if(y <> y_hat))::DOUBLE AS f1 FROM pred)
  SELECT floor(n * 0.2::DOUBLE)::BIGINT AS extra_rows, round(least(0.08::DOUBLE, greatest(0, 1 - f1) * 0.25), 6) AS gain_more_rows,
   round(least(0.06::DOUBLE, greatest(0, 1 - f1) * 0.2), 6) AS gain_cleaning FROM f""")
def _(t):
    best = metrics.summary(t.pred()).select(F.col("n").alias("n_rows"), F.col("f1_weighted").alias("f1"))
    return rounded(advise.what_if(best, "classification", "f1"), 6, "gain_more_rows", "gain_cleaning")
