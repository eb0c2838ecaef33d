"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """``top / bottom`` as double, ``empty`` where the bottom is zero or null."""
    out = F.try_divide(top.cast("double"), bottom.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def adjusted_skewness(value: Column) -> Column:
    n = F.count(value).cast("double")
    return F.skewness(value) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)


def adjusted_kurtosis(value: Column) -> Column:
    n = F.count(value).cast("double")
    return F.try_divide((n - 1) * ((n + 1) * F.kurtosis(value) + 6), (n - 2) * (n - 3))


def pearson(a: Column, b: Column) -> Column:
    """Correlation that is null, not an error, when a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def minmax_position(value: Column, low: Column, high: Column) -> Column:
    """Place of ``value`` on a 0-100 axis from low to high; an empty range counts as 1."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / span * 100


def right_closed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; null outside."""
    out = F.when(F.lit(False), F.lit(labels[0]))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((value > low) & (value <= high), F.lit(label))
    return out


def equal_width_bin(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """0-based bin; the last bin is closed, a constant column falls in bin 0."""
    width = (high - low) / bins
    place = F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0))
    return F.least(place, bins - 1).cast("long")


def hash_fraction(text: Column, start: int = 1) -> Column:
    """Eight hex digits of ``md5(text)`` as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_number(text: Column, start: int = 1) -> Column:
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("long")


# Confidence bands, lower bound first.
CONFIDENCE_BANDS = [(0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")]


def confidence_label(score: Column) -> Column:
    out = None
    for floor, label in CONFIDENCE_BANDS:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.otherwise("Very Low")
