"""Quality advice: issues with severity, threshold and a suggested fix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators import information, profile
from sondage.operators.prepare import medians
from sondage.plans.durable import materialise

# Thresholds of the issue rules.
LOW_VARIANCE = 0.01
LOW_INFORMATION = 0.01
HIGH_CORRELATION = 0.92
HIGH_SKEW = 1.5
HIGH_MISSING_PCT = 30.0
HIGH_IMBALANCE = 10.0
MODERATE_IMBALANCE = 5.0

# Advice per issue type.
TIPS = {
    "high_missing": "Consider removing columns with >30% missing values",
    "highly_skewed": "Apply log or Box-Cox transformation",
    "weak_near_zero_variance": "Remove features with near-zero variance",
    "redundant_high_correlation": "Remove one of highly correlated feature pairs",
    "class_imbalance": "Use SMOTE, class weighting, or adjust decision threshold",
}

# Wording of the suggested actions.
ACTIONS = {
    "near_zero_variance": 'Remove feature "%s" - near-zero variance (%.6f) indicates no discriminative power',
    "low_information": 'Consider removing or transforming "%s" - very low mutual information (%.4f) with target',
    "redundant": 'Features "%s" and "%s" are highly correlated (%.2f%%). Keep "%s" (MI=%.4f), remove "%s"',
    "skewed_log": 'Apply log1p transformation to "%s" - highly skewed (skewness=%.2f)',
    "skewed_power": 'Apply Box-Cox or Yeo-Johnson transformation to "%s" - highly skewed (skewness=%.2f)',
    "missing_high": 'Consider removing column "%s" - %.1f%% missing values exceeds 30%% threshold',
    "missing_some": 'Impute "%s" using %s imputation - %.1f%% missing values',
    "imbalance_high": "Class imbalance detected (ratio=%.1f). Consider SMOTE oversampling, class weighting, or threshold adjustment",
    "imbalance_moderate": 'Moderate class imbalance (ratio=%.1f). Consider class_weight="balanced" in your model',
    "healthy": "No significant feature issues detected.",
    "summary": "Found %d high, %d medium, and %d low severity issues.",
}

# Wording of the improvement suggestions.
SUGGESTIONS = {
    "missing": "Clean missing values in: %s. Use median/mode imputation or model-aware imputation.",
    "skewed": "Apply log/Yeo-Johnson transforms to skewed features: %s.",
    "imbalance": "Class imbalance detected. Try class weights, SMOTE, or threshold tuning.",
    "f1_low": "F1 is below 0.75. Add domain features, remove leakage/noise, tune hyperparameters, and check labeling quality.",
    "f1_good": "Performance is strong. Run repeated cross-validation and calibration before deployment.",
    "r2_low": "R2 is modest. Add interaction features, transform the target, inspect outliers, and tune tree depth/learning rate.",
    "r2_good": "Regression fit is promising. Validate residual assumptions and test on a holdout dataset.",
    "closing": "Export the best model only after checking learning curves, feature importance, and data drift across versions.",
}

# Limits of the suggestions and gains of the what-if scenarios.
GOOD_F1, GOOD_R2, SUGGEST_IMBALANCE, LISTED = 0.75, 0.6, 3.0, 5
MORE_ROWS = 0.2
GAIN_F1_ROWS, GAIN_F1_CLEANING, GAIN_R2_ROWS = (0.08, 0.25), (0.06, 0.2), (0.10, 0.25)

ISSUE_COLUMNS = ["feature", "issue_type", "severity", "metric_value", "threshold", "action", "recommended_transform"]


def _issues(rows: DataFrame, feature, kind, severity, metric: Column, threshold, action: Column, transform=None) -> DataFrame:
    def column(x, name):
        return (x if isinstance(x, Column) else F.lit(x)).alias(name)

    return rows.select(
        column(feature, "feature"), column(kind, "issue_type"), column(severity, "severity"),
        metric.alias("metric_value"), column(threshold, "threshold").cast("double"), action.alias("action"),
        (transform if transform is not None else F.lit(None).cast("string")).alias("recommended_transform"),
    )


def near_zero_variance(stats: DataFrame) -> DataFrame:
    """``stats``: rows of ``profile.moments``."""
    f, v = F.col("feature"), F.col("var_pop")
    text = F.format_string(ACTIONS["near_zero_variance"], f, v)
    return _issues(stats.where(v < LOW_VARIANCE), f, "weak_near_zero_variance", "high", F.round(v, 6), LOW_VARIANCE, text)


def low_information(info: DataFrame) -> DataFrame:
    f, v = F.col("feature"), F.col("mi")
    text = F.format_string(ACTIONS["low_information"], f, v)
    return _issues(info.where(v < LOW_INFORMATION), f, "weak_low_mutual_info", "medium", F.round(v, 4), LOW_INFORMATION, text)


def redundant_pairs(correlations: DataFrame, info: DataFrame) -> DataFrame:
    """Of a strongly correlated pair keep the feature with more information (the first on ties)."""
    scores = info.select("feature", "mi")
    strong = correlations.where(F.abs("corr") > HIGH_CORRELATION).select("a", "b", F.abs("corr").alias("r"))
    both = strong.join(scores.toDF("a", "mi_a"), "a").join(scores.toDF("b", "mi_b"), "b")
    first = F.col("mi_a") >= F.col("mi_b")
    keep = F.when(first, F.col("a")).otherwise(F.col("b"))
    drop = F.when(first, F.col("b")).otherwise(F.col("a"))
    text = F.format_string(
        ACTIONS["redundant"], F.col("a"), F.col("b"), F.col("r") * 100, keep, F.greatest("mi_a", "mi_b"), drop)
    return _issues(both, F.concat_ws("/", keep, drop), "redundant_high_correlation", "high", F.round("r", 4),
                   HIGH_CORRELATION, text)


def skewed_features(stats: DataFrame) -> DataFrame:
    f, v = F.col("feature"), F.col("skewness")
    hit = stats.where((F.col("n") > 3) & (F.abs(v) > HIGH_SKEW))
    log = F.col("low") >= 0
    text = F.when(log, F.format_string(ACTIONS["skewed_log"], f, v)).otherwise(
        F.format_string(ACTIONS["skewed_power"], f, v))
    return _issues(hit, f, "highly_skewed", "medium", F.round(v, 4), HIGH_SKEW, text,
                   F.when(log, "log1p").otherwise("Box-Cox"))


def missing_issues(missing: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``missing``: rows of ``profile.missing_by_column``."""
    pct = F.col("share") * 100
    f = F.col("feature")
    high = pct > HIGH_MISSING_PCT
    strategy = F.when(f.isin(list(numeric)), "median").otherwise("mode")
    text = F.when(high, F.format_string(ACTIONS["missing_high"], f, pct)).otherwise(
        F.format_string(ACTIONS["missing_some"], f, strategy, pct))
    return _issues(
        missing.where(pct > 0), f, F.when(high, "high_missing").otherwise("moderate_missing"),
        F.when(high, "high").otherwise("low"), F.round(pct, 2), HIGH_MISSING_PCT, text)


def imbalance_issue(df: DataFrame, target: str) -> DataFrame:
    r = F.col("imbalance_ratio")
    rows = profile.imbalance_ratio(df, target, cap=None).where(r > MODERATE_IMBALANCE)
    high = r > HIGH_IMBALANCE
    text = F.when(high, F.format_string(ACTIONS["imbalance_high"], r)).otherwise(
        F.format_string(ACTIONS["imbalance_moderate"], r))
    return _issues(rows, "target", F.when(high, "class_imbalance").otherwise("moderate_imbalance"),
                   F.when(high, "high").otherwise("medium"), F.round(r, 2),
                   F.when(high, HIGH_IMBALANCE).otherwise(MODERATE_IMBALANCE), text)


def imputed_copy(df: DataFrame, target: str) -> DataFrame:
    """Numeric nulls as the median, categorical ones as 'missing'; the target untouched."""
    fill = medians(df, numeric_columns(df, [target]))
    text = set(categorical_columns(df, [target]))
    return df.select(
        *[
            F.coalesce(profile.clean(c), F.lit(fill[c])).alias(c) if c in fill
            else F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) if c in text
            else F.col(c)
            for c in df.columns
        ]
    )


def advise(df: DataFrame, target: str) -> DataFrame:
    """All issues.  Missing values are judged on the raw table, the rest on an imputed copy."""
    numeric = numeric_columns(df, [target])
    roles = numeric + categorical_columns(df, [target])
    filled = imputed_copy(df, target)
    parts = [
        missing_issues(profile.missing_by_column(df.select(*roles)), numeric),
        imbalance_issue(df, target),
    ]
    if numeric:
        stats = profile.moments(filled, numeric)
        info = information.mutual_information(filled, numeric, target)
        parts += [near_zero_variance(stats), low_information(info), skewed_features(stats)]
        if len(numeric) > 1:
            parts.append(redundant_pairs(profile.correlations(filled, numeric), info))
    return profile.union_all(parts)


def health_summary(issues: DataFrame) -> DataFrame:
    """One row even without issues: status, counts by severity and by type, a sentence.

    The issues are read twice, so they are written first: a few rows per column.
    """
    issues = materialise(issues, "issues")
    high, medium, low = [F.count_if(F.col("severity") == s) for s in ("high", "medium", "low")]
    by_type = issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "n"))))
    ).scalar()
    counts = issues.agg(
        F.count(F.lit(1)).alias("total_issues"), high.alias("high_severity"), medium.alias("medium_severity"),
        low.alias("low_severity"),
    )
    status = (
        F.when(F.col("high_severity") > 0, "critical").when(F.col("medium_severity") > 0, "warning")
        .when(F.col("total_issues") > 0, "minor").otherwise("healthy")
    )
    text = F.when(F.col("total_issues") == 0, ACTIONS["healthy"]).otherwise(
        F.format_string(ACTIONS["summary"], "high_severity", "medium_severity", "low_severity"))
    return counts.select(status.alias("status"), "*", by_type.alias("issue_types"), text.alias("summary"))


def preprocessing_tips(issues: DataFrame) -> DataFrame:
    """(feature, issue_type, tip) for issue types that have one; five literals, no join."""
    tips = F.create_map(*[F.lit(x) for pair in TIPS.items() for x in pair])
    return issues.select("feature", "issue_type", F.try_element_at(tips, F.col("issue_type")).alias("tip")).where(
        F.col("tip").isNotNull()
    )


def improvement_suggestions(df: DataFrame, target: str, task: str, best_score: Column | float) -> DataFrame:
    """(position, suggestion) rows; ``best_score`` is the best F1 or R2."""
    spark = df.sparkSession

    def one(position, rows, text):
        return rows.select(F.lit(position).alias("position"), text.alias("suggestion"))

    always = spark.range(1)
    missing = profile.missing_by_column(df).where(F.col("missing") > 0).orderBy(F.col("share").desc(), "feature").limit(LISTED)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "feature")))
    holes = missing.agg(F.concat_ws(", ", F.transform(ordered, lambda x: x["feature"])).alias("t")).where(F.col("t") != "")
    rows = [one(1, holes, F.format_string(SUGGESTIONS["missing"], "t"))]
    numeric = numeric_columns(df, [target])
    if numeric:
        skewed = [r["feature"] for r in profile.moments(df, numeric).collect() if abs(r["skewness"] or 0.0) > HIGH_SKEW]
        distinct = profile.capped_distinct(df, skewed, 4) if skewed else {}
        names = [c for c in numeric if c in distinct and distinct[c][2] > 3][:LISTED]
        if names:
            rows.append(one(2, always, F.lit(SUGGESTIONS["skewed"] % ", ".join(names))))
    best = best_score if isinstance(best_score, Column) else F.lit(best_score)
    if task == "classification":
        uneven = profile.imbalance_ratio(df, target, cap=None).where(F.col("imbalance_ratio") > SUGGEST_IMBALANCE)
        rows.append(one(3, uneven, F.lit(SUGGESTIONS["imbalance"])))
        verdict = F.when(best < GOOD_F1, SUGGESTIONS["f1_low"]).otherwise(SUGGESTIONS["f1_good"])
    else:
        verdict = F.when(best < GOOD_R2, SUGGESTIONS["r2_low"]).otherwise(SUGGESTIONS["r2_good"])
    return profile.union_all([*rows, one(4, always, verdict), one(5, always, F.lit(SUGGESTIONS["closing"]))])


def what_if(best: DataFrame, task: str, score: str, rows: str = "n_rows") -> DataFrame:
    """Expected gains from more rows and from cleaning, from the best score's headroom."""
    headroom = F.greatest(F.lit(0.0), F.lit(1.0) - F.col(score))

    def gain(limits):
        most, share = limits
        return F.least(F.lit(most), headroom * share)

    extra = F.floor(F.col(rows) * F.lit(MORE_ROWS)).alias("extra_rows")
    if task == "classification":
        return best.select(extra, gain(GAIN_F1_ROWS).alias("gain_more_rows"), gain(GAIN_F1_CLEANING).alias("gain_cleaning"))
    return best.select(extra, gain(GAIN_R2_ROWS).alias("gain_more_rows"))
