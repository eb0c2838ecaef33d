"""Row numbers and running totals over an order, without one-task windows.

``row_number() over (order by x)`` pulls every row into one task, and
``partition by`` does the same to a hot key.  The functions here split the work
by position instead: a range-partitioned sort (which also cuts inside a hot
key, because the order includes a unique last column) is numbered per sorted
partition, and the small table of per-partition totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.plans.durable import materialise

SMALL_ROWS = 1_000_000
_LOW_BITS = (1 << 33) - 1


def _as_columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def sorted_positions(df: DataFrame, order) -> DataFrame:
    """Globally sorted rows with the partition (``_part``) and place (``_pos``) each got.

    Written out, because a second evaluation of the range partitioning could
    choose other boundaries.
    """
    numbered = df.orderBy(*_as_columns(order)).withColumn("_id", F.monotonically_increasing_id())
    return materialise(
        numbered.withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("_id"),
        "sorted",
    )


def running(
    df: DataFrame,
    order,
    within: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    row_name: str = "rn",
    maxima: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``row_name`` (1-based, per ``within`` group), inclusive running sums and maxima.

    ``order`` must be total inside a group.  ``sums`` and ``maxima`` map output
    name to input column.  The per-(group, partition) totals have at most one row per sorted
    partition and group boundary, so their own window stays small.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    within = list(within)
    ordered = sorted_positions(df, [*within, *order])
    keys = ["_part", *within]
    totals = ordered.groupBy(*keys).agg(
        F.min("_pos").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_max_{o}") for o, c in maxima.items()],
    )
    before = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums],
        *[F.max(f"_max_{o}").over(before).alias(f"_off_{o}") for o in maxima],
    )
    names = [c for c in ordered.columns if c not in ("_part", "_pos")]
    offsets = materialise(offsets, "offsets")
    if offsets.count() <= SMALL_ROWS:
        # Normally one row per sorted partition and group: checked, then broadcast.
        offsets = F.broadcast(offsets)
    joined = ordered.alias("o").join(offsets.alias("t"), _same(ordered, offsets, keys)).select(
        *[F.col(f"o.{c}") for c in ordered.columns],
        "_first",
        "_off_n",
        *[f"_off_{o}" for o in [*sums, *maxima]],
    )
    local = W.partitionBy(*keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(
        *names,
        (F.col("_off_n") + F.col("_pos") - F.col("_first") + 1).alias(row_name),
        *[(F.col(f"_off_{o}") + F.sum(c).over(local)).alias(o) for o, c in sums.items()],
        *[F.greatest(F.col(f"_off_{o}"), F.max(c).over(local)).alias(o) for o, c in maxima.items()],
    )


def cumulative(
    df: DataFrame,
    order,
    within: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    maxima: Mapping[str, str] | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Running sums and maxima of an already collapsed table.

    The table is written once and counted: up to ``small_rows`` a plain window
    is used, beyond that the distributed :func:`running`.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    written = materialise(df, "collapsed")
    if written.count() > small_rows:
        return running(written, order, within, sums, "_rn", maxima).drop("_rn")
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    scan = group.orderBy(*_as_columns(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return written.select(
        "*",
        *[F.sum(c).over(scan).alias(o) for o, c in sums.items()],
        *[F.max(c).over(scan).alias(o) for o, c in maxima.items()],
    )


def number_rows(df: DataFrame, order, within: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Exact ``row_number()`` per group; a hot group is spread over its sorted partitions."""
    return running(df, order, within, None, name)


def dictionary(df: DataFrame, column: str, name: str = "idx", small_rows: int = SMALL_ROWS) -> DataFrame:
    """The distinct values of a column, numbered from 0 in their order.

    Written once and counted: a small dictionary is numbered by a plain window,
    a large one by the distributed :func:`number_rows`.
    """
    values = materialise(df.select(column).distinct(), "dictionary")
    if values.count() <= small_rows:
        return values.withColumn(name, (F.row_number().over(W.orderBy(column)) - 1).cast("long"))
    return number_rows(values, [column], name=name).withColumn(name, F.col(name) - 1)


def hash_order(key: str, seed: int | str) -> Column:
    """A repeatable pseudo-random sort key, the same in any SQL engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def hash_ranks(
    df: DataFrame,
    key: str,
    seed: int | str,
    within: Sequence[str] = (),
    name: str = "rn",
    size_name: str | None = "group_size",
    digits: int = 4,
) -> DataFrame:
    """Row number in :func:`hash_order`, per group, plus the group's size.

    The hash spreads evenly, so its first hex digits are ready-made range
    buckets: 16**digits of them per group, numbered independently and offset by
    the counts of the buckets before.  No sort of a whole group takes place.
    """
    within = list(within)
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    keys = [*within, "_b"]
    counts = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        F.coalesce(
            F.sum("_n").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
        F.sum("_n").over(group).alias("_size"),
    )
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h", key)))
    out = ranked.join(offsets, _same(ranked, offsets, keys)).select(
        *[ranked[c] for c in df.columns],
        (F.col("_off") + F.col("_r")).alias(name),
        *([F.col("_size").alias(size_name)] if size_name else []),
    )
    return out


def trailing(
    df: DataFrame,
    order,
    within: Sequence[str],
    size: int,
    block: int = 50_000,
) -> tuple[DataFrame, W]:
    """Prepare ``rows between size-1 preceding and current row`` without one task per group.

    Each group is cut into blocks of ``block`` consecutive rows.  The last
    ``size - 1`` rows of a block are copied into the next one, marked
    ``_context``; drop them after evaluating the returned window.
    """
    numbered = number_rows(df, order, within, "_rn")
    last = (F.col("_rn") - 1) % block >= block - (size - 1)
    home = F.floor((F.col("_rn") - 1) / block)
    copies = F.when(
        last,
        F.array(
            F.struct(home.alias("_block"), F.lit(False).alias("_context")),
            F.struct((home + 1).alias("_block"), F.lit(True).alias("_context")),
        ),
    ).otherwise(F.array(F.struct(home.alias("_block"), F.lit(False).alias("_context"))))
    cut = numbered.select("*", F.inline(copies))
    window = W.partitionBy(*within, "_block").orderBy("_rn").rowsBetween(-(size - 1), W.currentRow)
    return cut, window
