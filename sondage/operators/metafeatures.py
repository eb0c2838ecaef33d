"""The meta-feature vector of one dataset, or of many at once: twenty features in four layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.scalars import pearson, ratio
from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators import information, profile
from sondage.operators.grouped import landmarks
from sondage.plans.durable import materialise
from sondage.plans.quantiles import column_quantile_sets, exact_quantiles


#: What a table without numeric columns has 0 of.
NUMERIC_NAMES = (
    "l2_mean_skewness", "l2_mean_kurtosis", "l2_mean_variance", "l2_mean_correlation", "l2_outlier_ratio",
    "l3_mean_mutual_info", "l3_max_mutual_info", "l3_redundancy_score")


def extract(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """One wide row: size and balance (l1), statistics (l2), information (l3) and, with a ``key``, landmarks (l4).

    Every part is a small aggregate; they meet as scalar subqueries of one row.
    Landmarks train models on folds, which the key assigns; it is no feature.
    """
    if key is not None:
        features = [c for c in df.columns if c not in (target, key)]
        scores = landmarks(df, None, key, [f for f in features if f in {*numeric_columns(df), *categorical_columns(df)}], target)
        found = scores.first().asDict()
        facts = extract(df.drop(key), target).select("*", *[F.lit(v).alias(n) for n, v in found.items()])
        return facts.select(*sorted(facts.columns))
    numeric = numeric_columns(df, [target])
    categorical = categorical_columns(df, [target])
    classes = profile.class_distribution(df.where(F.col(target).isNotNull()), target)
    facts = classes.agg(
        F.count(F.lit(1)).cast("double").alias("l1_n_classes"),
        F.least(ratio(F.max("n"), F.min("n")), F.lit(profile.CAP_IMBALANCE)).alias("l1_imbalance_ratio"),
        (-F.sum(F.col("share") * F.log2("share"))).alias("l3_class_entropy"),
    )
    facts = facts.select(
        "*",
        df.agg(F.count(F.lit(1)).cast("double")).scalar().alias("l1_n_instances"),
        F.lit(float(len(df.columns) - 1)).alias("l1_n_features"),
        F.lit(float(len(numeric))).alias("l1_n_numerical"),
        F.lit(float(len(categorical))).alias("l1_n_categorical"),
        profile.missing_pct(df, target).scalar().alias("l1_missing_pct"),
    )
    if numeric:
        # Rows without a target are left out; quartiles and bin limits come from the same passes.
        complete = df.where(F.col(target).isNotNull())
        quartiles, cuts = column_quantile_sets(
            complete, numeric, [([0.25, 0.75], False), (information.cut_points(), True)])
        mean = profile.moments(df, numeric, 3).agg(
            F.struct(F.avg("skewness").alias("s"), F.avg("kurtosis").alias("k"), F.avg("var_pop").alias("v"))
        ).scalar()
        info = information.mutual_information(df, numeric, target, cuts=cuts).agg(
            F.struct(F.avg("mi").alias("mean"), F.max("mi").alias("high"))
        ).scalar()
        facts = facts.select(
            "*", mean.alias("_m"), info.alias("_i"),
            profile.outlier_ratio(complete, numeric, quartiles).scalar().alias("l2_outlier_ratio"),
            (profile.mean_abs_correlation(df, numeric).scalar() if len(numeric) > 1 else F.lit(0.0)).alias("l2_mean_correlation"),
        ).select(
            "*", F.col("_m.s").alias("l2_mean_skewness"), F.col("_m.k").alias("l2_mean_kurtosis"),
            F.col("_m.v").alias("l2_mean_variance"), F.col("_i.mean").alias("l3_mean_mutual_info"),
            F.col("_i.high").alias("l3_max_mutual_info"), (F.col("_i.mean") * 2).alias("l3_redundancy_score"),
        ).drop("_m", "_i")
    else:
        facts = facts.select("*", *[F.lit(0.0).alias(n) for n in NUMERIC_NAMES])
    return facts.select(*sorted(facts.columns))


def to_long(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names]).unpivot(
        list(keys), names, "feature_name", "feature_value"
    )


def extract_grouped(df: DataFrame, dataset: str, features: Sequence[str], target: str) -> DataFrame:
    """The closed-form features of every dataset in one grouped pass, without a loop."""
    stats = {}
    for f in features:
        c = profile.clean(f)
        stats[f] = (F.skewness(c).alias(f"_s_{f}"), F.kurtosis(c).alias(f"_k_{f}"), F.var_pop(c).alias(f"_v_{f}"))
    per = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_instances"), *[e for s in stats.values() for e in s])

    def mean(prefix):
        every = F.filter(F.array(*[F.col(f"_{prefix}_{f}") for f in features]), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(every, F.lit(0.0), lambda a, b: a + b), F.size(every))

    classes = df.where(F.col(target).isNotNull()).groupBy(dataset, target).agg(F.count(F.lit(1)).alias("n"))
    n_ln_n = F.sum(F.col("n") * F.log2("n"))
    total = F.sum("n")
    balance = classes.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.least(ratio(F.max("n"), F.min("n")), F.lit(profile.CAP_IMBALANCE)).alias("imbalance_ratio"),
        (F.log2(total) - n_ln_n / total).alias("class_entropy"),
    )
    return balance.join(per, dataset).select(
        dataset, "n_instances", "n_classes", "imbalance_ratio", "class_entropy",
        mean("s").alias("mean_skewness"), mean("k").alias("mean_kurtosis"), mean("v").alias("mean_variance"),
    )


def extract_many(df: DataFrame, dataset: str, key: str, features: Sequence[str], target: str) -> DataFrame:
    """``dataset`` and the same features as :func:`extract` with a key gives, for every dataset at once.

    All passes are grouped by dataset; how many there are does not depend on the number of datasets.
    """
    numeric = [f for f in features if f in set(numeric_columns(df))]
    categorical = [f for f in features if f in set(categorical_columns(df))]
    name = F.coalesce(F.concat(F.lit("d"), F.col(dataset).cast("string")), F.lit("n")).alias("set")
    rows = materialise(df.select(
        name, *[profile.clean(f).cast("double").alias(f"x{i}") for i, f in enumerate(numeric)],
        *[F.col(f).alias(f"c{i}") for i, f in enumerate(categorical)], F.col(target).alias("y")), "datasets")
    x = [f"x{i}" for i in range(len(numeric))]
    n = F.count(F.lit(1))
    gaps = sum((F.count_if(F.col(c).isNull()) for c in rows.columns if c != "set"), F.lit(0))

    def mean(values):
        known = F.filter(F.array(*values), lambda v: v.isNotNull())
        return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known)), F.lit(0.0))

    moments = {f"_{kind}{c}": F.when(F.count(c) > 3, fn(c)) for kind, fn in (
        ("s", F.skewness), ("k", F.kurtosis), ("v", F.var_pop)) for c in x}
    pairs = {f"_r{a}_{b}": F.abs(pearson(F.col(a), F.col(b))) for i, a in enumerate(x) for b in x[i + 1:]}
    zero = F.lit(0.0)
    per = rows.groupBy("set").agg(
        n.cast("double").alias("l1_n_instances"),
        F.least(ratio(gaps, n * len(features)) * 100, F.lit(100.0)).alias("l1_missing_pct"),
        *[e.alias(k) for k, e in {**moments, **pairs}.items()]
    ).select(
        "set", "l1_n_instances", "l1_missing_pct", F.lit(float(len(features))).alias("l1_n_features"),
        F.lit(float(len(numeric))).alias("l1_n_numerical"), F.lit(float(len(categorical))).alias("l1_n_categorical"),
        *[(mean([F.col(f"_{kind}{c}") for c in x]) if x else zero).alias(out) for kind, out in (
            ("s", "l2_mean_skewness"), ("k", "l2_mean_kurtosis"), ("v", "l2_mean_variance"))],
        (mean([F.col(k) for k in pairs]) if pairs else zero).alias("l2_mean_correlation"))
    kept = rows.where(F.col("y").isNotNull())
    classes = kept.groupBy("set", "y").agg(n.alias("n"))
    total = F.sum("n")
    balance = classes.groupBy("set").agg(
        n.cast("double").alias("l1_n_classes"),
        F.least(ratio(F.max("n"), F.min("n")), F.lit(profile.CAP_IMBALANCE)).alias("l1_imbalance_ratio"),
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("l3_class_entropy"))
    parts = [balance]
    if x:
        items = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in x])
        long = kept.select("set", "y", F.inline(items)).where(F.col("v").isNotNull())
        by = ["set", "f"]
        quartiles = exact_quantiles(long, by, "v", [0.25, 0.75]).withColumnRenamed("q", "quartiles")
        deciles = exact_quantiles(long, by, "v", information.cut_points(), discrete=True).withColumnRenamed("q", "deciles")
        # One row per dataset and column.
        cuts = materialise(quartiles.join(deciles, by), "cuts")
        joined = long.join(cuts, by)
        q1, q3 = F.col("quartiles")[0], F.col("quartiles")[1]
        outside = (F.col("v") < q1 - (q3 - q1) * 1.5) | (F.col("v") > q3 + (q3 - q1) * 1.5)
        outliers = joined.groupBy(*by).agg(n.alias("n"), F.count_if(outside).alias("outliers")).where("n >= 4").groupBy("set").agg(
            ratio(F.sum("outliers"), F.sum("n")).alias("l2_outlier_ratio"))
        place = F.size(F.filter("deciles", lambda c: F.col("v") > c))
        cells = joined.groupBy(F.struct(*by).alias("pair"), place.alias("x"), "y").agg(n.alias("n"))
        told = information._information(cells, "pair", "x", "y").groupBy(F.col("pair.set").alias("set")).agg(
            F.avg("mi").alias("l3_mean_mutual_info"), F.max("mi").alias("l3_max_mutual_info"),
            (F.avg("mi") * 2).alias("l3_redundancy_score"))
        parts += [outliers, told]
    named = df.select(dataset).distinct().withColumn("set", name)
    scores = landmarks(df, dataset, key, [*numeric, *categorical], target).withColumn("set", name).drop(dataset)
    for part in (per, *parts, scores):
        named = named.join(part, "set", "left")
    every = sorted({*NUMERIC_NAMES, *named.columns} - {"set", dataset})
    return named.select(dataset, *[(F.coalesce(c, zero) if c in named.columns else zero).alias(c) for c in every])


# Grouped statistics and the meta-feature each one is.
GROUPED_NAMES = {
    "n_instances": "l1_n_instances", "n_classes": "l1_n_classes", "imbalance_ratio": "l1_imbalance_ratio",
    "mean_skewness": "l2_mean_skewness", "mean_kurtosis": "l2_mean_kurtosis", "mean_variance": "l2_mean_variance",
    "class_entropy": "l3_class_entropy",
}


def grouped_long(grouped: DataFrame, dataset: str) -> DataFrame:
    """(dataset, feature_name, feature_value) of :func:`extract_grouped`."""
    wide = grouped.select(dataset, *[F.col(a).cast("double").alias(b) for a, b in GROUPED_NAMES.items()])
    return to_long(wide, [dataset])
