"""Column profiles and whole-table statistics.

Statistics of many columns come from wide aggregates, a chunk of columns at a
time: no row is ever multiplied by the number of columns, every chunk reads only
its own columns, and each aggregate combines map-side.  Per-column facts that a
second pass needs (quartiles, ranges) are a few numbers per column; they are
read to the driver and go back into the plan as literals, so no join is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.scalars import adjusted_kurtosis, adjusted_skewness, equal_width_bin, ratio
from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.plans.comoments import comoments
from sondage.plans.durable import materialise
from sondage.plans.ordering import dictionary, hash_order
from sondage.plans.quantiles import as_double as clean
from sondage.plans.quantiles import column_quantiles, exact_quantiles

CHUNK = 40
# Aggregate expressions per scan that still compile into one generated function.
EXPRESSIONS_PER_SCAN = 50
CAP_IMBALANCE = 1000.0
# Stands for a column where there is none.
NO_FEATURE = "_none"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def column_aggregates(
    df: DataFrame, features: Sequence[str], make: Callable[[str], dict[str, Column]], chunk: int | None = None
) -> DataFrame:
    """One row per feature with the aggregates ``make(feature)`` returns, ``chunk`` features per scan."""
    frames = []
    if not features:
        # No columns: no rows, with the columns that ``make`` gives.
        none = df.select(F.lit(None).cast("double").alias(NO_FEATURE))
        return none.agg(F.lit("").alias("feature"), *[e.alias(n) for n, e in make(NO_FEATURE).items()]).where(F.lit(False))
    if chunk is None:
        chunk = max(2, EXPRESSIONS_PER_SCAN // max(1, len(make(features[0]))))
    for start in range(0, len(features), chunk):
        rows = [
            F.struct(F.lit(f).alias("feature"), *[e.alias(n) for n, e in make(f).items()])
            for f in features[start:start + chunk]
        ]
        frames.append(df.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    return union_all(frames)


# -- whole table -----------------------------------------------------------------------------


def shape(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_instances")).withColumn("n_features", F.lit(len(df.columns) - 1))


def absent(df: DataFrame) -> dict[str, Column]:
    """Per column whether its value is missing: null, or NaN in a number."""
    numeric = set(numeric_columns(df))
    return {c: F.isnull(clean(c)) if c in numeric else F.isnull(c) for c in df.columns}


def missing_by_column(df: DataFrame) -> DataFrame:
    """(feature, missing, share) for every column, most missing first."""
    gaps = absent(df)

    def stats(c):
        n = F.count_if(gaps.get(c, F.lit(False)))
        return {"missing": n, "share": ratio(n, F.count(F.lit(1)))}

    return column_aggregates(df, df.columns, stats).orderBy(F.col("missing").desc(), "feature")


def missing_pct(df: DataFrame, target: str) -> DataFrame:
    """Missing cells of all columns over rows x feature count, in percent, at most 100."""
    total = reduce(lambda a, b: a + b, [F.count_if(a) for a in absent(df).values()])
    cells = F.count(F.lit(1)) * (len(df.columns) - 1)
    return df.agg(F.least(ratio(total, cells) * 100, F.lit(100.0)).alias("missing_pct"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # The total of the counts, whose exchange is used again.
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total))


def imbalance_ratio(df: DataFrame, target: str, cap: float | None = CAP_IMBALANCE) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    value = ratio(F.max("n"), F.min("n"))
    return counts.agg((F.least(value, F.lit(cap)) if cap else value).alias("imbalance_ratio"))


def class_entropy(df: DataFrame, target: str) -> DataFrame:
    p = F.col("share")
    return class_distribution(df, target).agg((-F.sum(p * F.log2(p))).alias("class_entropy"))


def distinct_target(df: DataFrame, target: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(target) if approximate else F.count_distinct(target)
    return df.agg(count.alias("distinct_target"))


def role_counts(df: DataFrame) -> DataFrame:
    """Columns and cells per role and type."""
    numeric, categorical = set(numeric_columns(df)), set(categorical_columns(df))
    roles = [
        ("numeric" if f.name in numeric else "categorical" if f.name in categorical else "other",
         f.dataType.simpleString())
        for f in df.schema
    ]
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(d).alias("dtype")) for r, d in roles])
    rows = df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(items))
    return rows.groupBy("role", "dtype").agg(F.count(F.lit(1)).alias("columns"), F.sum("n_rows").alias("cells"))


def row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row; equal rows have equal ones."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def repeated_rows(df: DataFrame) -> DataFrame:
    """The distinct rows that occur more than once, with ``_n``, their number.

    Hashes are counted first, so that what is shuffled for a row does not depend on its width.
    Rows with a hash of their own are settled by that; the others are compared whole, and copies collapse before that shuffle.
    """
    h1, h2 = row_hash(df)
    counted = df.select(h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_rows"))
    shared = materialise(counted.where("_rows > 1").select("_h1", "_h2"), "repeated")
    some = df.select("*", h1.alias("_h1"), h2.alias("_h2")).join(shared, ["_h1", "_h2"], "left_semi").drop("_h1", "_h2")
    return some.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows."""
    return repeated_rows(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def fingerprint(df: DataFrame) -> DataFrame:
    gaps = reduce(lambda a, b: a + b, [a.cast("long") for a in absent(df).values()])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_total"),
    ).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_total",
        F.lit(len(numeric_columns(df))).alias("numeric_columns"), duplicate_rows(df).scalar().alias("duplicate_rows"),
    )


def dataset_hash(df: DataFrame) -> DataFrame:
    """Identity of schema and content, whatever the row order and partitioning.

    Doubles print differently between engines; pass keys, integers and text.
    """
    schema = F.md5(F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in df.columns])
    piece = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(piece), F.lit(0)).alias("content_hash")
    ).withColumn("schema_hash", schema)


# -- per column ------------------------------------------------------------------------------


def moments(df: DataFrame, features: Sequence[str], min_rows: int = 0) -> DataFrame:
    """n, mean, var_pop, biased skewness and excess kurtosis per feature."""

    def stats(f):
        c = clean(f)
        out = {"n": F.count(c), "mean": F.avg(c), "var_pop": F.var_pop(c), "skewness": F.skewness(c),
               "kurtosis": F.kurtosis(c), "low": F.min(c), "high": F.max(c)}
        return out

    rows = column_aggregates(df, features, stats)
    return rows.where(F.col("n") > min_rows) if min_rows else rows


def top_variance(df: DataFrame, features: Sequence[str], k: int = 10) -> DataFrame:
    rows = column_aggregates(df, features, lambda f: {"variance": F.var_samp(clean(f))})
    return rows.orderBy(F.col("variance").desc(), "feature").limit(k)


def _named_comoments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(a, b, corr, var)`` for a at or before b in ``features``; corr is null where undefined, ``var`` is that of a."""
    found = comoments(df, {f: clean(f) for f in features})
    names = F.array(*[F.lit(f) for f in features])
    corr = F.try_divide("cov", F.sqrt(F.col("var_a")) * F.sqrt(F.col("var_b")))
    return found.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), corr.alias("corr"), F.col("var_a").alias("var"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, corr) for a before b in ``features``; null where undefined.

    One scan for all pairs, whatever their number (see ``plans.comoments``).
    """
    features = list(features)
    if len(features) < 2:
        return df.select(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("corr")).limit(0)
    return _named_comoments(df, features).where("a != b").select("a", "b", "corr")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All ordered pairs, undefined as 0 and the diagonal as 1 (0 for a constant)."""
    features = list(features)
    if not features:
        return df.select(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("corr")).limit(0)
    found = _named_comoments(df, features)
    sides = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    own = F.col("a") == F.col("b")
    value = F.when(own, (F.col("var") > 0).cast("double")).otherwise(F.col("corr"))
    return found.select(F.inline(F.when(own, F.slice(sides, 1, 1)).otherwise(sides)), F.coalesce(value, F.lit(0.0)).alias("corr"))


def mean_abs_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return correlations(df, features).agg(F.avg(F.abs("corr")).alias("mean_abs_correlation"))


def fences(q1: float, q3: float) -> tuple[float, float]:
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def outliers_by_column(
    df: DataFrame, features: Sequence[str], min_rows: int = 4, quartiles: dict[str, list[float]] | None = None
) -> DataFrame:
    """(feature, n, q1, q3, outliers) by the 1.5 IQR rule, strict at the fences."""
    quartiles = quartiles or column_quantiles(df, features, [0.25, 0.75])

    def stats(f):
        if f not in quartiles:
            return {"n": F.count(clean(f)), "q1": F.lit(None).cast("double"), "q3": F.lit(None).cast("double"),
                    "outliers": F.lit(0).cast("long")}
        q1, q3 = quartiles[f][0], quartiles[f][-1]
        low, high = fences(q1, q3)
        c = clean(f)
        return {"n": F.count(c), "q1": F.lit(q1), "q3": F.lit(q3), "outliers": F.count_if((c < low) | (c > high))}

    return column_aggregates(df, features, stats).where(F.col("n") >= min_rows)


def outlier_ratio(
    df: DataFrame, features: Sequence[str], quartiles: dict[str, list[float]] | None = None
) -> DataFrame:
    rows = outliers_by_column(df, features, quartiles=quartiles)
    return rows.agg(ratio(F.sum("outliers"), F.sum("n")).alias("outlier_ratio"))


def box_stats(df: DataFrame, features: Sequence[str], key: str, shown: int = 50) -> DataFrame:
    """Five numbers per feature and up to ``shown`` outliers, the most extreme first."""
    q = column_quantiles(df, features, [0.0, 0.25, 0.5, 0.75, 1.0])
    features = [f for f in features if f in q]
    five = column_aggregates(
        df, features,
        lambda f: {"n": F.count(clean(f)), **{n: F.lit(q[f][i]) for i, n in
                                              enumerate(["low", "q1", "median", "q3", "high"])}},
    ).where(F.col("n") >= 4)
    beyond = []
    for f in features:
        low, high = fences(q[f][1], q[f][3])
        excess = F.greatest(F.lit(low) - clean(f), clean(f) - F.lit(high))
        beyond.append(F.struct(F.lit(f).alias("feature"), clean(f).alias("value"), excess.alias("excess")))
    outside = (
        df.select(F.col(key).alias("_key"), F.explode(F.array(*beyond)).alias("o")).select("_key", "o.*")
        .where(F.col("excess") > 0)
    )
    # row_number() <= k is limited per map task before the shuffle (WindowGroupLimit).
    rank = F.row_number().over(W.partitionBy("feature").orderBy(F.col("excess").desc(), "value", "_key"))
    kept = outside.withColumn("r", rank).where(F.col("r") <= shown)
    lists = kept.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("outliers")
    )
    return five.join(lists, "feature", "left").withColumn(
        "outliers", F.coalesce("outliers", F.array().cast("array<double>"))
    )


def capped_distinct(df: DataFrame, features: Sequence[str], cap: int) -> dict[str, tuple[float, float, int]]:
    """(min, max, least(distinct, cap)) per column.

    A quantile sketch returns real data values; ``cap`` different ones prove the
    cap is reached.  Only columns the sketch cannot settle are counted exactly,
    and those are mostly the ones with few values.
    """
    probe = [i / (2.0 * cap) for i in range(2 * cap + 1)]
    rows = column_aggregates(
        df, features,
        lambda f: {"low": F.min(clean(f)), "high": F.max(clean(f)),
                   "seen": F.size(F.array_distinct(F.percentile_approx(clean(f), probe, 1000)))},
    ).collect()
    facts = {r["feature"]: (r["low"], r["high"], r["seen"]) for r in rows if r["low"] is not None}
    open_ = [f for f, (_, _, seen) in facts.items() if seen < cap]
    exact = {}
    if open_:
        exact = {r["feature"]: r["k"] for r in column_aggregates(
            df, open_, lambda f: {"k": F.count_distinct(clean(f))}).collect()}
    return {f: (low, high, min(cap, exact.get(f, cap))) for f, (low, high, _) in facts.items()}


def histogram(
    df: DataFrame, features: Sequence[str], bins: int = 20, by: Sequence[str] = (), fixed: bool = False
) -> DataFrame:
    """(by..., feature, bin, low, high, n) with equal-width bins; empty bins of a group are kept.

    ``fixed`` takes ``bins`` as given, otherwise least(bins, distinct values).
    """
    facts = capped_distinct(df, features, bins)
    plan = {f: (low, high, bins if fixed else max(1, k)) for f, (low, high, k) in facts.items()}
    if not plan:
        zero = F.lit(0).cast("long")
        return df.select(
            *by, F.lit("").alias("feature"), zero.alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
            zero.alias("n")).limit(0)
    items = [
        F.struct(
            F.lit(f).alias("feature"),
            F.when(
                clean(f).isNotNull(),
                equal_width_bin(clean(f), F.lit(low), F.lit(high), F.lit(k)),
            ).alias("bin"),
        )
        for f, (low, high, k) in plan.items()
    ]
    counts = (
        df.select(*by, F.explode(F.array(*items)).alias("h")).select(*by, "h.*")
        .where(F.col("bin").isNotNull()).groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.lit(low).alias("_low"),
                F.lit((high - low) / k).alias("_w"), F.lit(k).alias("_k"),
            )
            for f, (low, high, k) in plan.items()
        ]
    )
    groups = counts.select(*by).distinct() if by else counts.agg(F.count(F.lit(1)).alias("_any")).drop("_any")
    frame = groups.select(*by, F.inline(grid)).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1)).alias("bin")
    )
    return frame.join(counts, [*by, "feature", "bin"], "left").select(
        *by, "feature", "bin", (F.col("_low") + F.col("_w") * F.col("bin")).alias("low"),
        (F.col("_low") + F.col("_w") * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def stats_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """mean, median, sample std, bias-corrected skew and kurtosis per feature."""
    median = column_quantiles(df, features, [0.5])

    def stats(f):
        c = clean(f)
        return {
            "mean": F.avg(c), "median": F.lit(median[f][0] if f in median else None).cast("double"),
            "std": F.stddev_samp(c), "skew": adjusted_skewness(c), "kurt": adjusted_kurtosis(c),
        }

    return column_aggregates(df, features, stats)


def profile_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Everything per numeric column: exact quartiles, then one aggregate."""
    q = column_quantiles(df, features, [0.25, 0.5, 0.75])
    features = [f for f in features if f in q]
    q = q or {NO_FEATURE: [0.0, 0.0, 0.0]}

    def stats(f):
        c = clean(f)
        low, high = fences(q[f][0], q[f][2])
        return {
            "n": F.count(c), "missing": F.count_if(c.isNull()), "mean": F.avg(c), "median": F.lit(q[f][1]),
            "std": F.stddev_samp(c), "skew": adjusted_skewness(c), "kurt": adjusted_kurtosis(c),
            "low": F.min(c), "q1": F.lit(q[f][0]), "q3": F.lit(q[f][2]), "high": F.max(c),
            "outliers": F.count_if((c < low) | (c > high)),
        }

    return column_aggregates(df, features, stats)


def dataset_profile(df: DataFrame, target: str) -> DataFrame:
    """The whole profile as (section, name, metric, value) rows."""
    numeric = numeric_columns(df)

    def rows(frame, section, name, metrics):
        return frame.select(
            F.lit(section).alias("section"), name.alias("name"),
            F.inline(F.array(*[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])),
        )

    table = fingerprint(df).withColumn("categorical_columns", F.col("n_columns") - F.col("numeric_columns"))
    parts = [
        rows(table, "table", F.lit("table"), ["n_rows", "n_columns", "numeric_columns", "categorical_columns",
                                              "missing_total", "duplicate_rows"]),
        rows(distinct_target(df, target), "table", F.lit("target"), ["distinct_target"]),
        rows(missing_by_column(df).where(F.col("missing") > 0), "missing", F.col("feature"), ["missing"]),
        rows(profile_columns(df, numeric), "numeric", F.col("feature"),
             ["mean", "median", "std", "skew", "kurt", "low", "q1", "q3", "high", "outliers"]),
        rows(correlation_matrix(df, numeric), "correlation", F.concat_ws("~", "a", "b"), ["corr"]),
        rows(histogram(df, numeric), "histogram", F.concat_ws("~", "feature", "bin"), ["n"]),
    ]
    return union_all(parts)


# -- groups ----------------------------------------------------------------------------------


def group_count_2d(df: DataFrame, a: str, b: str, margins: bool = False) -> DataFrame:
    grouped = df.cube(a, b) if margins else df.groupBy(a, b)
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def mean_by_bin(df: DataFrame, bin_label: Column, metric: str, labels: Sequence[str]) -> DataFrame:
    """Mean per label, labels without rows kept (their mean is null)."""
    found = df.groupBy(bin_label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "bin string")
    return names.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def flow_links(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Links a->b and b->c with counts and zero-based node numbers in name order."""
    two = [
        df.groupBy(F.concat_ws("=", F.lit(x), x).alias("source"), F.concat_ws("=", F.lit(y), y).alias("sink"))
        .agg(F.count(F.lit(1)).alias("n"))
        for x, y in ((a, b), (b, c))
    ]
    links = union_all(two)
    names = links.select(F.col("source").alias("name")).union(links.select("sink")).distinct()
    nodes = dictionary(names, "name", "node")
    return links.join(nodes.select(F.col("name").alias("source"), F.col("node").alias("source_node")), "source").join(
        nodes.select(F.col("name").alias("sink"), F.col("node").alias("sink_node")), "sink"
    )


def grouped_quantiles(df: DataFrame, by: str, feature: str) -> DataFrame:
    """Quartiles and whisker ends per class."""
    long = df.select(F.col(by), clean(feature).alias("value"))
    q = exact_quantiles(long, [by], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["low", "q1", "median", "q3", "high"]
    return q.select(by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def pair_sample(df: DataFrame, key: str, features: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """Up to five numeric columns of ``rows`` rows in a repeatable random order."""
    return df.orderBy(hash_order(key, seed), key).limit(rows).select(key, *list(features)[:5])
