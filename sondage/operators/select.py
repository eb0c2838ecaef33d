"""Projections, filters and rule rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators.profile import absent

# Names that mark a target column, best first.
TARGET_NAMES = ["target", "label", "class", "y", "outcome"]

# Wording of the validation issues.
VALIDATION = {
    "empty": "Dataset is empty",
    "no_target": "Target column '%s' not found in dataset",
    "few_classes": "Target column must have at least 2 unique classes",
    "few_rows": "Dataset too small for reliable analysis (minimum %d samples)",
}

# Task, confidence and reason of the task rules, and their limits.
TASK_RULES = {
    "categorical": ("classification", 0.95, "Target is categorical."),
    "few_integers": ("classification", 0.8, "Integer target has few unique values."),
    "continuous": ("regression", 0.85, "Numeric target has many continuous values."),
    "unclear": ("classification", 0.55, "Task is ambiguous; review the target manually."),
}
FEW_VALUES, FEW_SHARE = 20, 0.1

# Wording and limits of the explanations.
EXPLANATIONS = {
    "small": "Small dataset (%d samples) - simpler models may generalize better",
    "large": "Large dataset (%d samples) - complex ensemble methods can leverage the data",
    "imbalance": "Class imbalance detected (ratio: %.1f) - ensemble methods recommended",
    "bayes_wins": "Naive Bayes outperforms Decision Stump - suggests simpler decision boundaries",
    "stump_wins": "Decision Tree outperforms Naive Bayes - suggests non-linear relationships",
    "similar": "Based on analysis of %d similar historical datasets",
}
SMALL_ROWS, LARGE_ROWS, IMBALANCED = 500, 10000, 5


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def select_by_role(df: DataFrame, role: str, exclude: Sequence[str] = ()) -> DataFrame:
    pick = numeric_columns if role == "numeric" else categorical_columns
    return df.select(*pick(df, exclude))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def coerce_numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Parse the target to double and drop the rows that do not parse."""
    return df.withColumn(target, F.col(target).try_cast("double")).where(
        F.col(target).isNotNull() & ~F.isnan(target)
    )


def filter_in(df: DataFrame, column: str, kept: Sequence) -> DataFrame:
    return df.where(F.col(column).cast("string").isin([str(v) for v in kept]))


def filter_positive_sort(counts: DataFrame, count: str, tie: str) -> DataFrame:
    return counts.where(F.col(count) > 0).orderBy(F.col(count).desc(), tie)


def ok_models(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("status") == "ok")


def validate_dataset(df: DataFrame, target: str, min_rows: int = 10) -> DataFrame:
    """One row ``(valid, issues)``.  Two classes exist exactly when min and max differ."""
    found = target in df.columns
    y = F.col(target) if found else F.lit(None).cast("string")
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("a"), F.max(y).alias("b"))
    empty, few_classes = F.col("n") == 0, ~F.coalesce(F.col("a") < F.col("b"), F.lit(False))
    if found:
        rest = F.array(
            F.when(few_classes, VALIDATION["few_classes"]),
            F.when(F.col("n") < min_rows, VALIDATION["few_rows"] % min_rows),
        )
    else:
        rest = F.array(F.lit(VALIDATION["no_target"] % target))
    issues = F.when(empty, F.array(F.lit(VALIDATION["empty"]))).otherwise(F.array_compact(rest))
    return facts.select((F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def infer_target(columns: Sequence[str]) -> str:
    """First well-known target name in any letter case, else the last column."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    for name in TARGET_NAMES:
        if name in by_lower:
            return by_lower[name]
    return columns[-1]


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """One row ``(task, confidence, reason)`` from the target's type and cardinality."""
    kind = df.schema[target].dataType
    y = F.col(target)
    facts = df.where(y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(y).alias("k")
    ).withColumn("share", F.col("k") / F.greatest(F.col("n"), F.lit(1)))
    categorical = F.lit(not isinstance(kind, T.NumericType))
    integral = F.lit(isinstance(kind, T.IntegralType))
    few = (F.col("k") <= FEW_VALUES) | (F.col("share") <= FEW_SHARE)

    def verdict(name: str) -> Column:
        task, confidence, reason = TASK_RULES[name]
        return F.struct(
            F.lit(task).alias("task"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    rule = (
        F.when(categorical, verdict("categorical")).when(integral & few, verdict("few_integers"))
        .when(~few, verdict("continuous")).otherwise(verdict("unclear"))
    )
    return facts.select(rule.alias("r"), F.col("n").alias("n_rows"), F.col("k").alias("n_distinct")).select(
        "r.*", "n_rows", "n_distinct"
    )


def fill_constants(df: DataFrame, text: str = "missing", number: float = 0.0) -> DataFrame:
    return df.na.fill(number, numeric_columns(df)).na.fill(text, categorical_columns(df))


def explanation(
    instances: Column, imbalance: Column, stump: Column, bayes: Column, similar: Column
) -> Column:
    """Why an algorithm is recommended, as an array of sentences."""
    def said(name, *values):
        return F.format_string(EXPLANATIONS[name], *values)

    rows = instances.cast("long")
    return F.array_compact(F.array(
        F.when(instances < SMALL_ROWS, said("small", rows)).when(instances > LARGE_ROWS, said("large", rows)),
        F.when(imbalance > IMBALANCED, said("imbalance", imbalance.cast("double"))),
        F.when(bayes > stump, EXPLANATIONS["bayes_wins"]).otherwise(EXPLANATIONS["stump_wins"]),
        F.when(similar > 0, said("similar", similar.cast("long"))),
    ))


def missing_map(df: DataFrame, key: str, columns: Sequence[str], rows: int = 200) -> DataFrame:
    """0/1 matrix of missing cells of the first ``rows`` rows by key, as (key, column, is_missing)."""
    gaps = absent(df)
    flags = [gaps[c].cast("int").alias(c) for c in columns]
    return (
        df.select(key, *columns).orderBy(key).limit(rows).select(key, *flags)
        .unpivot([key], list(columns), "column", "is_missing")
    )
