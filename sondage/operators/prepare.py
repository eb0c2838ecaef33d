"""Encoding, imputation, cleaning, splitting and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.scalars import hash_fraction, hash_number, ratio
from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators import profile
from sondage.plans.durable import materialise
from sondage.plans.neighbours import nearest
from sondage.plans.ordering import dictionary, hash_ranks

MAX_ONE_HOT = 10_000

# Wording of the change log, and the limits of the log transform.
CHANGES = {
    "median": "Filled %s (numeric) missing values with median.",
    "mode": "Filled %s (categorical) missing values with mode.",
    "duplicates": "Removed %d duplicate rows.",
    "log": "Applied log transform to skewed feature: %s.",
    "clip": "Clipped %d outliers in %s to IQR bounds.",
    "imbalance": "Class imbalance detected (ratio: %.1f). Consider SMOTE or class weights in model training.",
}
LOG_SKEW, LOG_DISTINCT, WARN_IMBALANCE = 1.5, 10, 3.0


# -- encoding --------------------------------------------------------------------------------


def label_dictionary(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    """(label, idx) with idx counting from 0 in label order; a null is a class of its own."""
    label = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    return dictionary(df.select(label.alias("label")), "label")


def label_encode(df: DataFrame, column: str, out: str | None = None, missing: str = "missing") -> DataFrame:
    """Add the class number.  The join is left to the optimizer: a small dictionary
    is broadcast below its size threshold, a large one is joined with skew handling."""
    names = label_dictionary(df, column, missing)
    coded = df.withColumn("_label", F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    return coded.join(names.withColumnRenamed("label", "_label"), "_label").select(
        *df.columns, F.col("idx").alias(out or f"{column}_idx")
    )


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories per column; they become columns, so their number is checked."""
    out = {}
    for c in columns:
        values = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(
            MAX_ONE_HOT + 1).collect()]
        if len(values) > MAX_ONE_HOT:
            raise ValueError(f"{c} has more than {MAX_ONE_HOT} categories; encode it with label_encode")
        out[c] = sorted(values)
    return out


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column ``column_value`` per category; unknown and missing give all zeros."""
    values = values if values is not None else categories(df, [column])[column]
    flags = [
        F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values
    ]
    return df.select(*[c for c in df.columns if c != column], *flags)


def feature_names(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(position, feature): numeric names, then ``column_value`` per category."""
    values = categories(df, categorical)
    names = list(numeric) + [f"{c}_{v}" for c in categorical for v in values[c]]
    return df.sparkSession.createDataFrame(list(enumerate(names)), "position long, feature string")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    facts = counts.agg(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weight = ratio(facts["n"], facts["k"] * F.col("n_c"))
    return counts.withColumn("weight", weight)


def with_class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    return df.join(class_weights(df, target).select(target, F.col("weight").alias(out)), target)


# -- imputation and scaling ------------------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {f: q[0] for f, q in profile.column_quantiles(df, columns, [0.5]).items()} if columns else {}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; 'Unknown' when all are null."""
    columns = list(columns)
    if not columns:
        return {}
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(items)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = {r["i"]: r["v"] for r in counts.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).collect()}
    return {c: best.get(i, "Unknown") for i, c in enumerate(columns)}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = medians(df, columns)
    return df.select(
        *[F.coalesce(profile.clean(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns]
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = modes(df, columns)
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(fill[c]).try_cast(types[c])).alias(c) if c in fill else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes zero."""
    facts = {
        r["feature"]: (r["mean"], r["std"])
        for r in profile.column_aggregates(
            df, columns, lambda f: {"mean": F.avg(profile.clean(f)), "std": F.stddev_pop(profile.clean(f))}
        ).collect()
    }

    def scaled(c):
        mean, std = facts[c]
        return (profile.clean(c) - F.lit(mean)) / F.lit(std or 1.0)

    return df.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# -- cleaning --------------------------------------------------------------------------------


def log_candidates(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with min > 0, |skewness| > 1.5 and more than ten distinct values."""
    facts = {r["feature"]: r for r in profile.moments(df, columns).collect()}
    skewed = [
        c for c in columns
        if facts[c]["low"] is not None and facts[c]["low"] > 0 and abs(facts[c]["skewness"] or 0.0) > LOG_SKEW
    ]
    distinct = profile.capped_distinct(df, skewed, LOG_DISTINCT + 1) if skewed else {}
    return [c for c in skewed if distinct[c][2] > LOG_DISTINCT]


def log1p_skewed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    chosen = log_candidates(df, columns)
    return df.select(*[F.log1p(profile.clean(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]), chosen


def clip_iqr(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Clamp to the 1.5 IQR fences; also how many cells of each column changed."""
    quartiles = profile.column_quantiles(df, columns, [0.25, 0.75])
    counts = {
        r["feature"]: r["outliers"]
        for r in profile.outliers_by_column(df, columns, min_rows=0, quartiles=quartiles).collect()
    }

    def clipped(c):
        low, high = profile.fences(*quartiles[c])
        value = profile.clean(c)
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))

    done = df.select(*[clipped(c).alias(c) if counts.get(c) else F.col(c) for c in df.columns])
    return done, {c: n for c, n in counts.items() if n}


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def auto_fix(df: DataFrame, target: str, task: str = "classification", aggressive: bool = False):
    """Impute, deduplicate and, if ``aggressive``, log and clip.  Returns (clean, change log).

    The target is never imputed.  Quartiles are taken after the log step.  The
    log has one row per change: (step, feature, change).
    """
    numeric = numeric_columns(df, [target])
    categorical = categorical_columns(df, [target])
    missing = {r["feature"]: r["missing"] for r in profile.missing_by_column(df).collect()}
    log: list[tuple[int, str, str]] = []
    holes = [c for c in numeric if missing[c]]
    clean = impute_median(df, holes) if holes else df
    log += [(1, c, CHANGES["median"] % c) for c in holes]
    gaps = [c for c in categorical if missing[c]]
    clean = impute_mode(clean, gaps) if gaps else clean
    log += [(2, c, CHANGES["mode"] % c) for c in gaps]

    single = materialise(clean.dropDuplicates(), "deduplicated")
    extra = df.count() - single.count()
    if extra:
        log.append((3, "*", CHANGES["duplicates"] % extra))
    clean = single
    if aggressive:
        clean, logged = log1p_skewed(clean, numeric)
        log += [(4, c, CHANGES["log"] % c) for c in logged]
        clean, clipped = clip_iqr(clean, numeric)
        log += [(5, c, CHANGES["clip"] % (clipped[c], c)) for c in numeric if c in clipped]
        if task == "classification":
            r = profile.imbalance_ratio(clean, target, cap=None).first()[0]
            if r and r > WARN_IMBALANCE:
                log.append((6, target, CHANGES["imbalance"] % r))
    changes = df.sparkSession.createDataFrame(log, "step int, feature string, change string")
    return clean, changes


def fix_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after) for rows, missing cells and duplicates."""
    metrics = ["n_rows", "missing_total", "duplicate_rows"]

    def long(df, name):
        return profile.fingerprint(df).select(*[F.col(m).cast("long") for m in metrics]).unpivot(
            [], metrics, "metric", name)

    return long(before, "before").join(long(after, "after"), "metric")


# -- splitting -------------------------------------------------------------------------------


def stratified_split(df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``; class shares are kept when every class has at least two rows.

    The order inside a class is the md5 of seed and key, numbered in hash
    buckets, so a class holding most of the table is not sorted in one task.
    """
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    within = [target] if smallest and smallest >= 2 else []
    ranked = hash_ranks(df, key, seed, within)
    return ranked.select(
        *df.columns, (F.col("rn") <= F.ceil(F.col("group_size") * F.lit(float(test_share)))).alias("is_test")
    )


def kfold_assign(df: DataFrame, key: str, target: str | None, k: int = 5, seed: int = 42) -> DataFrame:
    ranked = hash_ranks(df, key, seed, [target] if target else [], size_name=None)
    return ranked.select(*df.columns, F.pmod(F.col("rn") - 1, F.lit(k)).cast("int").alias("fold"))


def safe_folds(df: DataFrame, target: str, folds: int) -> int:
    """least(folds, rows, smallest class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total, smallest = counts.agg(F.sum("n"), F.min("n")).first()
    return int(min(folds, total or 0, smallest or 0))


# -- resampling and corruption ---------------------------------------------------------------


def smote(df: DataFrame, key: str, vector: str, target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows (source, copy, target, vector) that bring every class to the largest.

    Each class row gets an equal number of copies (the first ones in hash order
    one more).  A copy moves a hash-chosen part of the way to a hash-chosen one
    of the row's ``k`` nearest neighbours of the same class.
    """
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    largest = counts.agg(F.max("n_c")).scalar()
    needs = counts.withColumn("need", largest - F.col("n_c")).where((F.col("need") > 0) & (F.col("n_c") > 1))
    ranked = hash_ranks(df.select(key, vector, target), key, seed, [target], size_name=None)
    rows = materialise(
        ranked.join(needs, target).select(
            key, vector, target, "n_c",
            (F.floor(F.col("need") / F.col("n_c")) + (F.col("rn") <= F.col("need") % F.col("n_c")).cast("int")).alias("copies"),
        ),
        "smote",
    )
    names = label_dictionary(rows, target)
    coded = rows.join(names, rows[target].cast("string") == names["label"]).select(key, vector, F.col("idx").alias("grp"))
    near = nearest(coded, coded, k, key, vector, group="grp", same_group=True, exclude_self=True)
    copies = rows.where(F.col("copies") > 0).select(
        key, vector, target, "n_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    tag = F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))
    among = F.least(F.lit(k).cast("long"), F.col("n_c") - 1)
    asked = copies.select(
        F.col(key).alias("query"), "copy", target, F.col(vector).alias("a"),
        (F.pmod(hash_number(F.concat(F.lit(f"{seed}-pick-"), tag)), among) + 1).cast("int").alias("rank"),
        hash_fraction(F.concat(F.lit(f"{seed}-gap-"), tag)).alias("gap"),
    )
    picked = asked.join(near.select("query", "rank", "neighbour"), ["query", "rank"])
    other = rows.select(F.col(key).alias("neighbour"), F.col(vector).alias("b"))
    mixed = F.zip_with(
        F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), lambda x, y: x + (y - x) * F.col("gap")
    )
    return picked.join(other, "neighbour").select(
        F.col("query").alias("source"), "copy", target, "neighbour", mixed.alias(vector)
    )


def inject_missing(df: DataFrame, key: str, column: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Null out floor(share * n) cells of one column, chosen by hash order."""
    ranked = hash_ranks(df, key, seed)
    hit = F.col("rn") <= F.floor(F.col("group_size") * F.lit(float(share)))
    return ranked.select(*[F.when(~hit, F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def inject_noise(df: DataFrame, key: str, columns: Sequence[str], scale: float = 0.5, seed: int = 42) -> DataFrame:
    """Add normal noise of ``scale`` sample standard deviations to up to two columns.

    The normal deviate is a Box-Muller transform of two hash fractions of the
    key, so a retried task repeats it.
    """
    columns = list(columns)[:2]
    std = df.agg(*[F.stddev_samp(profile.clean(c)).alias(c) for c in columns]).first()

    def noisy(c):
        text = F.concat(F.lit(f"{seed}-{c}-"), F.col(key).cast("string"))
        u1 = F.greatest(hash_fraction(text), F.lit(1e-12))
        u2 = hash_fraction(text, 9)
        normal = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
        return profile.clean(c) + normal * F.lit((std[c] or 0.0) * scale)

    return df.select(*[noisy(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# -- preparation for Spark ML ----------------------------------------------------------------


def preparation(numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> Pipeline:
    """Impute, scale, index and one-hot mixed columns into one vector; unseen categories give zeros."""
    stages = []
    parts = []
    if numeric:
        filled = [f"_{c}_filled" for c in numeric]
        stages += [
            Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_numeric", handleInvalid="keep"),
            StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    for c in categorical:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"_{c}_idx", stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCol=f"_{c}_idx", outputCol=f"_{c}_hot", dropLast=True),
        ]
        parts.append(f"_{c}_hot")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric inputs as double with NaN as null, as the imputer expects."""
    return df.select(*[profile.clean(c).alias(c) if c in columns else F.col(c) for c in df.columns])
