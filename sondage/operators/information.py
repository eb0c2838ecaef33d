"""Binned mutual information.

Numeric features are cut at their exact deciles (equal values share a bin), so
after the deciles are known one scan builds all contingency counts with
map-side combine; nothing is sorted.  With counts n, Sum over cells of
n ln n, signed + for (bin, y) and the total and - for the two margins, divided by
the rows, is the mutual information in nats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.schema import categorical_columns, numeric_columns
from sondage.operators.profile import clean, column_quantiles, union_all

BINS = 10
#: Between a column's name and its value until the end, so that a_b, c and a, b_c stay apart.
_BETWEEN = "\x00"


def bin_number(feature: str, cuts: Sequence[float]) -> Column:
    """Number of cuts strictly below the value; null for a missing value."""
    value = F.col(feature)
    place = F.lit(0)
    for c in cuts:
        place = place + (value > c).cast("int")
    return F.when(value.isNotNull(), place)


def cut_points(bins: int = BINS) -> list[float]:
    return [i / bins for i in range(1, bins)]


def binned(
    df: DataFrame, features: Sequence[str], bins: int = BINS, cuts: dict[str, list[float]] | None = None
) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with its numeric features as clean doubles, and a bin expression per feature.

    Numbers get an integer bin, categories are their own bins.
    """
    numeric = set(numeric_columns(df))
    wanted = [f for f in dict.fromkeys(features) if f in numeric]
    if cuts is None:
        cuts = column_quantiles(df, wanted, cut_points(bins), discrete=True) if wanted else {}
    cleaned = df.select(*[clean(c).alias(c) if c in wanted else F.col(c) for c in df.columns])
    out = {
        f: bin_number(f, cuts.get(f, [])) if f in numeric else F.coalesce(F.col(f).cast("string"), F.lit("missing"))
        for f in features
    }
    return cleaned, out


def contingency(df: DataFrame, bins: dict[str, Column], y: Column) -> DataFrame:
    """Counts (feature, x, y, n), from one scan for numeric bins and one for categories.

    The scan groups by small integers; names and texts are attached to the counts.
    """
    numeric = set(numeric_columns(df))
    frames = []
    for chosen in ([f for f in bins if f in numeric], [f for f in bins if f not in numeric]):
        if not chosen:
            continue
        items = F.array(*[F.struct(F.lit(i).alias("i"), bins[f].alias("x")) for i, f in enumerate(chosen)])
        names = F.array(*[F.lit(f) for f in chosen])
        counts = df.select(y.alias("y"), F.inline(items)).where(F.col("x").isNotNull()).groupBy("i", "x", "y").agg(
            F.count(F.lit(1)).alias("n"))
        frames.append(counts.select(
            names[F.col("i")].alias("feature"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n"))
    return union_all(frames)


def _information(cells: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """(name, mi, bias, n) from contingency rows (name, a, b, n)."""
    margins = cells.groupingSets(
        [[name, a, b], [name, a], [name, b], [name]], name, a, b
    ).agg(F.sum("n").cast("double").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    sign = F.when(F.col("ga") == F.col("gb"), 1.0).otherwise(-1.0)
    total = F.max(F.when((F.col("ga") == 1) & (F.col("gb") == 1), F.col("n")))
    rows_a = F.count_if((F.col("ga") == 0) & (F.col("gb") == 1))
    rows_b = F.count_if((F.col("ga") == 1) & (F.col("gb") == 0))
    return margins.groupBy(name).agg(
        F.greatest(F.sum(sign * F.col("n") * F.ln("n")) / total, F.lit(0.0)).alias("mi"),
        ((rows_a - 1) * (rows_b - 1) / (2.0 * total)).alias("bias"),
        total.cast("long").alias("n"),
    )


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, regression: bool = False, bins: int = BINS,
    cuts: dict[str, list[float]] | None = None,
) -> DataFrame:
    """(feature, mi, bias, n): information of each feature about the target.

    ``bias`` is the first-order upward bias of the plug-in estimate, reported
    beside it.  A regression target is cut into deciles as well.  ``cuts`` are the
    columns' bin limits over the rows with a target, if known already.
    """
    kept = df.where(F.col(target).isNotNull())
    names = list(features) + ([target] if regression else [])
    cleaned, bins_of = binned(kept, names, bins, cuts)
    y = bins_of.pop(target) if regression else F.col(target)
    return _information(contingency(cleaned, bins_of, y), "feature", "x", "y")


def joint_information(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """(pair, mi, bias, n) between the binned features of every pair."""
    cleaned, e = binned(df, features, bins)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    items = F.array(*[
        F.struct(F.lit(f"{a}~{b}").alias("pair"), e[a].cast("string").alias("x"), e[b].cast("string").alias("z")) for a, b in pairs])
    cells = (
        cleaned.select(F.inline(items))
        .where(F.col("x").isNotNull() & F.col("z").isNotNull())
        .groupBy("pair", "x", "z").agg(F.count(F.lit(1)).alias("n"))
    )
    return _information(cells, "pair", "x", "z")


def redundancy_score(information: DataFrame) -> DataFrame:
    """Mean over feature pairs of the sum of both informations: twice the mean."""
    return information.agg((F.avg("mi") * 2).alias("redundancy_score"))


def feature_signal(df: DataFrame, features: Sequence[str], target: str, regression: bool = False) -> DataFrame:
    """Information per encoded feature (numbers as they are, one 0/1 column per category), ranked."""
    numeric = [f for f in features if f in set(numeric_columns(df))]
    categorical = [f for f in features if f in set(categorical_columns(df))]
    kept = df.where(F.col(target).isNotNull())
    kept, bins_of = binned(kept, numeric + ([target] if regression else []))
    y = (bins_of.pop(target) if regression else F.col(target)).cast("string")
    cells = contingency(kept, bins_of, y) if bins_of else None
    if categorical:
        # Counts for x=1 come from the category; x=0 is the class total minus them.
        value = [
            F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("v"))
            for c in categorical
        ]
        ones = (
            kept.select(y.alias("y"), F.explode(F.array(*value)).alias("i")).select("y", "i.*")
            .groupBy(F.concat_ws(_BETWEEN, "c", "v").alias("feature"), "y").agg(F.count(F.lit(1)).alias("n1"))
        )
        classes = kept.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n_y"))
        per_class = ones.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("y", "n1"))).alias("m"))
        every = classes.agg(F.collect_list(F.struct("y", "n_y"))).scalar()
        both = per_class.select("feature", "m", F.inline(every)).select(
            "feature", "y", F.coalesce(F.try_element_at("m", F.col("y")), F.lit(0)).alias("n1"), "n_y"
        )
        flags = both.select(
            "feature", "y",
            F.inline(F.array(
                F.struct(F.lit("1").alias("x"), F.col("n1").alias("n")),
                F.struct(F.lit("0").alias("x"), (F.col("n_y") - F.col("n1")).alias("n")),
            )),
        ).where(F.col("n") > 0)
        cells = flags if cells is None else cells.unionByName(flags.select(*cells.columns))
    name = F.replace(F.col("feature"), F.lit(_BETWEEN), F.lit("_")).alias("feature")
    return _information(cells, "feature", "x", "y").select(name, F.col("mi").alias("score")).orderBy(
        F.col("score").desc(), "feature"
    )
