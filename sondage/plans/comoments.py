"""Co-moments of all pairs of columns in one scan.

Every task keeps, for its rows, the matrices X'X, X'M, (X*X)'M and M'M, where M marks
the values that are there and X has 0 for the others.  So each pair is taken over the rows
that have both, whatever the pattern of gaps.  The columns are shifted by their mean
first, which one small aggregate finds, and that keeps the sums accurate.  Partial matrices
become rows by pair and are added with map-side combine.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions travel to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of one side that a scan takes: eight matrices of this square stay in a task.
TILE = 512
#: A variance below this share of the mean square, both about the shift, is rounding.
ROUNDING = 1e-12
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def comoments(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(i, j, n, var_a, var_b, cov)`` by the numbers of the columns, i at most j, over the rows that have both."""
    names = list(columns)
    values = df.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(columns.values())])
    mean = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first() if names else []
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in mean])
    tiles = [range(s, min(s + TILE, len(names))) for s in range(0, len(names), TILE)]
    parts = None
    for k, left in enumerate(tiles):
        for right in tiles[k:]:
            found = _tile(values, shift, left, right)
            parts = found if parts is None else parts.unionAll(found)
    if parts is None:
        return df.sparkSession.createDataFrame([], "i int, j int, n double, var_a double, var_b double, cov double")
    n = F.col("n")
    ma, mb = F.col("sa") / n, F.col("sb") / n

    def variance(squares, m):
        v = squares / n - m * m
        return F.when(v > F.lit(ROUNDING) * squares / n, v).otherwise(F.lit(0.0))

    added = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    some = added.withColumn("n", F.nullif("n", F.lit(0.0)))
    return some.select(
        "i", "j", F.coalesce("n", F.lit(0.0)).alias("n"), variance(F.col("saa"), ma).alias("var_a"),
        variance(F.col("sbb"), mb).alias("var_b"), (F.col("sab") / n - ma * mb).alias("cov"))


def _tile(values: DataFrame, shift: np.ndarray, left: range, right: range) -> DataFrame:
    """Partial sums of the pairs of ``left`` and ``right``, a row per task and pair."""
    wanted = sorted({*left, *right})
    at = {c: k for k, c in enumerate(wanted)}
    a, b = [at[c] for c in left], [at[c] for c in right]

    def run(batches):
        total = np.zeros((len(_SUMS), len(left), len(right)))
        for batch in batches:
            if batch.schema.names == ["id"]:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - shift[wanted]
            m = np.isfinite(x)
            x, m = np.where(m, x, 0.0), m.astype(np.float64)
            xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
            for t, sums in zip(total, (ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb)):
                t += sums
        i, j = np.repeat(np.array(left), len(right)), np.tile(np.array(right), len(left))
        keep = i <= j
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *[pa.array(t.ravel()[keep]) for t in total]],
            ["i", "j", *_SUMS])

    kinds = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    # One task without rows, so that a table without partitions has all pairs, too.
    none = values.sparkSession.range(0, 1, 1, 1).mapInArrow(run, kinds)
    return values.select(*[f"x{c}" for c in wanted]).mapInArrow(run, kinds).unionAll(none)
