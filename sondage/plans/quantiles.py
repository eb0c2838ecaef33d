"""Exact quantiles that stay exact and distributed on large tables.

Of whole columns: repeated histograms close in on the wanted ranks.  Each pass
is one scan with map-side combine and returns a few numbers per column; only the
rows of the last, narrow intervals are ever ordered.

Of groups: the built-in ``percentile`` keeps every distinct value of a group in
one buffer.  It is used while a checked row count keeps that buffer small.
Beyond that, a sketch brackets each wanted rank, one pass counts what lies below
the bracket, and only the rows inside it (a few parts per million) are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.plans.durable import materialise

BUFFER_ROWS = 5_000_000
SKETCH_ACCURACY = 100_000
HISTOGRAM_BINS = 2048
ORDERED_ROWS = 1_000_000
SMALL_GROUPS = 10_000


def as_double(column: str) -> Column:
    """The column as double with NaN as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _wanted_ranks(n: int, p: float, discrete: bool) -> list[int]:
    """0-based ranks that decide quantile ``p`` of ``n`` values."""
    if discrete:
        return [max(math.ceil(Fraction(p).limit_denominator(1_000_000) * n), 1) - 1]
    at = (n - 1) * p
    return [math.floor(at), math.ceil(at)]


def order_statistics(
    df: DataFrame, ranks: dict[str, set[int]], facts: dict[str, dict], bins: int = HISTOGRAM_BINS,
    ordered_rows: int = ORDERED_ROWS,
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each double column's sorted non-null values.

    ``facts`` holds each column's finite ``low`` and ``high``, its count of
    finite values ``n`` and of negative infinities ``neg``.
    """
    found: dict[str, dict[int, float]] = {f: {} for f in ranks}
    # An interval is (column, low, high, values below it, values inside, its ranks).
    slots = []
    for f, wanted in ranks.items():
        a = facts[f]
        inside = {r for r in wanted if a["neg"] <= r < a["neg"] + a["n"]}
        found[f].update({r: -math.inf if r < a["neg"] else math.inf for r in wanted - inside})
        if inside:
            slots.append((f, a["low"], a["high"], a["neg"], a["n"], inside))
    while slots:
        done = [s for s in slots if s[1] == s[2]]
        for f, low, _, _, _, wanted in done:
            found[f].update(dict.fromkeys(wanted, low))
        slots = [s for s in slots if s[1] < s[2]]
        if not slots:
            break
        if sum(s[4] for s in slots) <= ordered_rows:
            _order_slots(df, slots, found)
            break
        slots = _narrow_slots(df, slots, bins)
    return found


def _slot_rows(df: DataFrame, slots, bins: int | None) -> DataFrame:
    """(slot, bin, v) of the cells inside an interval.  Intervals of a column are disjoint."""
    items = []
    for f in dict.fromkeys(s[0] for s in slots):
        v = F.col(f)
        slot, place = None, None
        for i, (g, low, high, *_) in enumerate(slots):
            if g != f:
                continue
            hit = (v >= low) & (v <= high)
            slot = F.when(hit, i) if slot is None else slot.when(hit, i)
            if bins:
                # Halved ends keep the widest ranges finite; the expression never decreases in v.
                span = high / 2 - low / 2
                at = F.least(F.floor((v / 2 - low / 2) / F.lit(span) * bins), F.lit(bins - 1))
                place = F.when(hit, at) if place is None else place.when(hit, at)
        items.append(F.struct(slot.alias("slot"), (place if bins else F.lit(0)).cast("long").alias("bin"), v.alias("v")))
    return df.select(F.inline(F.array(*items))).where(F.col("slot").isNotNull())


def _narrow_slots(df: DataFrame, slots, bins: int):
    counts = _slot_rows(df, slots, bins).groupBy("slot", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # At most ``bins`` rows per interval.
    upto = F.sum("n").over(W.partitionBy("slot").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    tests = []
    for i, (_, _, _, below, _, wanted) in enumerate(slots):
        for r in sorted(wanted):
            tests.append(F.struct(F.lit(i).alias("s"), F.lit(r - below).cast("long").alias("r")))
    asked = F.array(*tests)
    hit = F.exists(asked, lambda t: (t["s"] == F.col("slot")) & (t["r"] < F.col("upto")) & (t["r"] >= F.col("upto") - F.col("n")))
    kept = counts.withColumn("upto", upto).where(hit).collect()
    out = []
    for row in kept:
        f, _, _, below, _, wanted = slots[row["slot"]]
        start = below + row["upto"] - row["n"]
        inside = {r for r in wanted if start <= r < start + row["n"]}
        out.append((f, row["low"], row["high"], start, row["n"], inside))
    return out


def _order_slots(df: DataFrame, slots, found) -> None:
    values = _slot_rows(df, slots, None).groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("slot").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    asked = F.array(*[
        F.struct(F.lit(i).alias("s"), F.lit(r - s[3]).cast("long").alias("r")) for i, s in enumerate(slots) for r in sorted(s[5])])
    hits = F.filter(asked, lambda t: (t["s"] == F.col("slot")) & (t["r"] < F.col("upto")) & (t["r"] >= F.col("upto") - F.col("n")))
    for row in values.withColumn("upto", upto).select("slot", "v", F.explode(hits).alias("t")).collect():
        f, _, _, below, *_ = slots[row["slot"]]
        found[f][row["t"]["r"] + below] = row["v"]


def column_quantile_sets(
    df: DataFrame, features: Sequence[str], requests: Sequence[tuple[Sequence[float], bool]],
    bins: int = HISTOGRAM_BINS, ordered_rows: int = ORDERED_ROWS, chunk: int = 40,
) -> list[dict[str, list[float]]]:
    """Exact quantiles for several (probs, discrete) requests in the same passes.

    Each answer has plain numbers per column; all-null columns are left out.
    """
    out: list[dict[str, list[float]]] = [{} for _ in requests]
    for start in range(0, len(features), chunk):
        part = list(features)[start:start + chunk]
        columns = df.select(*[as_double(f).alias(f) for f in part])
        facts = _column_facts(columns, part)
        ranks = {
            f: {r for probs, discrete in requests for p in probs for r in _wanted_ranks(a["all"], p, discrete)}
            for f, a in facts.items() if a["all"]}
        values = order_statistics(columns, ranks, facts, bins, ordered_rows)
        for answer, (probs, discrete) in zip(out, requests):
            for f, got in values.items():
                n = facts[f]["all"]
                answer[f] = []
                for p in probs:
                    r = _wanted_ranks(n, p, discrete)
                    low, high = got[r[0]], got[r[-1]]
                    answer[f].append(low if discrete or low == high else low + (high - low) * ((n - 1) * p - r[0]))
    return out


def column_quantiles(
    df: DataFrame, features: Sequence[str], probs: Sequence[float], discrete: bool = False,
    bins: int = HISTOGRAM_BINS, ordered_rows: int = ORDERED_ROWS,
) -> dict[str, list[float]]:
    """Exact quantiles per column as plain numbers: len(features) x len(probs)."""
    return column_quantile_sets(df, features, [(probs, discrete)], bins, ordered_rows)[0]


def _column_facts(df: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    exprs = []
    for i, f in enumerate(features):
        v = F.col(f)
        finite = F.when(F.abs(v) < F.lit(math.inf), v)
        exprs += [F.min(finite).alias(f"low{i}"), F.max(finite).alias(f"high{i}"), F.count(finite).alias(f"n{i}"),
                  F.count(v).alias(f"all{i}"), F.count_if(v == F.lit(-math.inf)).alias(f"neg{i}")]
    row = df.agg(*exprs).first()
    return {f: {k: row[f"{k}{i}"] for k in ("low", "high", "n", "all", "neg")} for i, f in enumerate(features)}


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., feature, value)`` with double values; NaN becomes null."""
    wide = df.select(*keep, *[as_double(c).alias(c) for c in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def exact_quantiles(
    long: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    discrete: bool = False,
    buffer_rows: int = BUFFER_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per group: ``by..., q`` with ``q`` an array parallel to ``probs``.

    ``discrete`` picks the order statistic at rank ceil(p*n); otherwise the two
    neighbours of (n-1)*p are interpolated linearly.  Nulls are ignored.
    """
    by = list(by)
    rows = long.where(F.col(value).isNotNull())
    if rows.count() <= buffer_rows:
        if not discrete:
            q = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]))
            return rows.groupBy(*by).agg(q.alias("q"))
        return _by_buffered_ranks(rows, by, value, probs)
    return _by_brackets(rows, by, value, probs, discrete, accuracy)


def _by_buffered_ranks(rows, by, value, probs):
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.select(*by, value, upto.alias("_upto"), F.sum("_n").over(group).alias("_total"))
    picks = [
        F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.lit(float(p)) * F.col("_total")), F.lit(1)), F.col(value)))
        for p in probs
    ]
    return ranked.groupBy(*by).agg(F.array(*picks).alias("q"))


def _by_brackets(rows, by, value, probs, discrete, accuracy):
    slack = 2.0 / accuracy
    edges = []
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        F.percentile_approx(value, edges, accuracy).alias("_e"),
    )
    # One row per group and probability: wanted ranks (0-based) and the bracket.
    if discrete:
        def first(p):
            return F.greatest(F.ceil(F.lit(float(p)) * F.col("_total")), F.lit(1)) - 1
        second = first
    else:
        def first(p):
            return F.floor((F.col("_total") - 1) * F.lit(float(p)))

        def second(p):
            return F.ceil((F.col("_total") - 1) * F.lit(float(p)))
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"),
                first(p).cast("long").alias("_lo"),
                second(p).cast("long").alias("_hi"),
                ((F.col("_total") - 1) * F.lit(float(p))).alias("_at"),
                F.col("_e")[2 * i].alias("_from"),
                F.when(F.lit(p + slack >= 1.0), F.lit(float("inf"))).otherwise(F.col("_e")[2 * i + 1]).alias("_to"),
            )
            for i, p in enumerate(probs)
        ]
    )
    sketch = materialise(sketch, "sketch")
    if sketch.count() <= SMALL_GROUPS:
        # One row per group, checked: the rows need no shuffle to meet it.
        sketch = F.broadcast(sketch)
    brackets = sketch.select(*by, F.explode(wanted).alias("_w")).select(*by, "_w.*")
    paired = (
        rows.select(*by, F.col(value).alias("_v"))
        .join(sketch.select(*by, wanted.alias("_ws")), by)
        .select(*by, "_v", F.explode("_ws").alias("_w"))
        .select(*by, "_v", "_w._i", "_w._from", "_w._to")
    )
    zone = F.when(F.col("_v") < F.col("_from"), -1).when(F.col("_v") > F.col("_to"), 1).otherwise(0)
    # All rows below a bracket, and all above, collapse into one row each in the
    # map-side combine; they keep the value next to the bracket.
    counted = paired.groupBy(*by, "_i", zone.alias("_z"), F.when(zone == 0, F.col("_v")).alias("_in")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    next_to = F.when(F.col("_z") < 0, F.col("_most")).otherwise(F.col("_least"))
    scan = W.partitionBy(*by, "_i").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_v", next_to).withColumn("_upto", F.sum("_n").over(scan)).join(brackets, [*by, "_i"])
    # The one row kept per side is right only for the rank next to the bracket.
    missed = (
        (F.col("_z") < 0) & (F.col("_lo") < F.col("_upto") - 1)
        | (F.col("_z") > 0) & (F.col("_hi") > F.col("_upto") - F.col("_n"))
    )
    checked = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank; raise the accuracy"))).otherwise(F.col("_v"))
    found = placed.groupBy(*by, "_i").agg(
        F.min(F.when(F.col("_upto") > F.col("_lo"), checked)).alias("_a"),
        F.min(F.when(F.col("_upto") > F.col("_hi"), checked)).alias("_b"),
        F.first(F.col("_at") - F.col("_lo")).alias("_part"),
    )
    answer = F.col("_a") if discrete else F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return (
        found.select(*by, "_i", answer.alias("_q"))
        .groupBy(*by)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))
    )
