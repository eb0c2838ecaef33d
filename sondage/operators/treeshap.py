"""Exact Shapley values of tree models, path-dependent: what each feature adds to a row's prediction.

The value of a set of known features is the expectation of the model when the path is
followed where the feature is known and split by the training rows' shares where it is not.  For
one leaf this is a product over the features on its path, each either "the row goes this way"
(1 or 0) or the share of the training rows that do.  The Shapley sum of a product is the integral of a
polynomial between 0 and 1, which Gauss-Legendre quadrature with half as many nodes as
features gives exactly.  So the work per leaf is a few matrix operations, with no recursion over rows.

Rows between the same cuts in every feature have the same values.  A fitted model has few cuts per feature, so
each row is first given its cell, the values are worked out once per distinct cell, and rows fetch them by a
join.  Inside a leaf, cells that meet the same conditions of its path share the quadrature.

The node table comes from the saved form of the fitted model.  It is no larger than the model itself,
which scoring sends to the tasks just so.  The values of a row sum to its prediction less the
mean prediction over the training rows (``base``).  Classification forests and trees are
explained in probabilities, boosted classifiers in their margin, regressors in their prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.plans.durable import materialise, scratch_path

# Functions travel to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Conditions of leaves whose rows are kept in memory, and cells that one task works on at a time.
REMEMBERED, CELLS = 2048, 1024

class Leaves:
    """All leaves of an ensemble: value, and by feature on the path what a row must satisfy and the share of rows that go on."""

    def __init__(self, model):
        spark = SparkSession.active()
        folder = scratch_path(spark, "trees")
        model.write().overwrite().save(folder)
        nodes = spark.read.parquet(f"{folder}/data")
        single = "treeID" not in nodes.columns
        rows = nodes.select(F.lit(0).alias("t") if single else F.col("treeID").alias("t"), *[
            F.col(c if single else f"nodeData.{c}").alias(c) for c in ("id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split")])
        by_tree: dict[int, dict] = {}
        for r in rows.collect():
            by_tree.setdefault(r["t"], {})[r["id"]] = r
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        kind = type(model).__name__
        self.votes = "Classification" in kind and not kind.startswith("GBT")
        # Forests average their trees; boosted trees add up.
        total = 1.0 if kind.startswith("GBT") else sum(weights)
        self.leaves = []
        self.cuts: dict[int, np.ndarray] = {}
        for t in sorted(by_tree):
            self._walk(by_tree[t], 0, {}, weights[t] / total)
        for _, path in self.leaves:
            for f, (low, high, allowed, _) in path.items():
                seen = self.cuts.setdefault(f, set() if allowed is None else None)
                if allowed is None:
                    seen |= {low, high}
        self.cuts = {f: None if v is None else np.array(sorted(v - {-np.inf, np.inf})) for f, v in self.cuts.items()}
        self.base = sum(v * np.prod([share for *_, share in path.values()]) for v, path in self.leaves)

    def _walk(self, nodes, at, path, weight) -> None:
        stack = [(at, path)]
        while stack:
            at, path = stack.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                stats = np.array(node["impurityStats"], dtype=float)
                value = stats / stats.sum() if self.votes else np.array([node["prediction"]])
                self.leaves.append((weight * value, path))
                continue
            split = node["split"]
            feature, categories = split["featureIndex"], split["numCategories"]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                low, high, allowed, share = path.get(feature, (-np.inf, np.inf, None, 1.0))
                if categories < 0:
                    cut = split["leftCategoriesOrThreshold"][0]
                    low, high = (low, min(high, cut)) if left else (max(low, cut), high)
                else:
                    side = frozenset(map(int, split["leftCategoriesOrThreshold"]))
                    side = side if left else frozenset(range(categories)) - side
                    allowed = side if allowed is None else allowed & side
                share *= nodes[child]["rawCount"] / node["rawCount"]
                stack.append((child, {**path, feature: (low, high, allowed, share)}))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Per row a vector between the same cuts, the same for all rows of a cell; unused features are 0."""
        out = np.zeros(x.shape)
        for f, cuts in self.cuts.items():
            if cuts is None:
                out[:, f] = x[:, f]
            else:
                top = np.append(cuts, np.inf)
                out[:, f] = np.where(np.isnan(x[:, f]), np.nan, top[np.searchsorted(cuts, x[:, f])])
        return out + 0.0

    def values(self, x: np.ndarray, outputs=slice(None)) -> np.ndarray:
        """``(rows, features, outputs)`` of Shapley values."""
        out = np.zeros((*x.shape, len(self.leaves[0][0][outputs])))
        known: dict[tuple, np.ndarray] = {}
        rules: dict[int, tuple] = {}

        def met(f, low, high, allowed):
            """Which rows satisfy the condition; leaves share most conditions."""
            found = known.get((f, low, high, allowed))
            if found is None:
                column = x[:, f]
                found = ((column > low) & (column <= high)) if allowed is None else np.isin(column, list(allowed))
                if len(known) >= REMEMBERED:
                    known.clear()
                known[f, low, high, allowed] = found
            return found

        for value, path in self.leaves:
            if not path:
                continue
            features = list(path)
            share = np.array([path[f][3] for f in features])
            conditions = [met(f, *path[f][:3]) for f in features]
            pattern = np.zeros(len(x), dtype=np.int64)
            for k, condition in enumerate(conditions):
                # Numbered anew before they fill the integer.
                if k and k % 30 == 0:
                    pattern = np.unique(pattern, return_inverse=True)[1].ravel()
                pattern = pattern * 2 + condition
            _, first, group = np.unique(pattern, return_index=True, return_inverse=True)
            group = group.ravel()
            inside = np.stack([condition[first] for condition in conditions], axis=1).astype(float)
            m = len(features)
            if m not in rules:
                rules[m] = _quadrature(m)
            nodes, weights = rules[m]
            # factor: (rows, features, nodes); a share of zero has no training rows and no weight.
            factor = inside[:, :, None] * nodes + share[:, None] * (1 - nodes)
            whole = factor.prod(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = whole[:, None, :] / factor
            lost = ~np.isfinite(rest)
            if lost.any():
                for k in range(len(features)):
                    if lost[:, k].any():
                        rest[:, k] = np.delete(factor, k, axis=1).prod(axis=1)
            part = (inside - share) * (rest @ weights)
            out[:, features] += part[group][:, :, None] * value[outputs]
        return out


def _quadrature(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on (0, 1), exact to degree m - 1."""
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    return (nodes + 1) / 2, weights / 2


def tree_attribution(model, rows: DataFrame, key: str, names: Sequence[str], output: int | None = None) -> DataFrame:
    """``(key, feature, value, base)``: the part of each feature in each row's prediction.

    ``output`` chooses the class of a classifier, the last one if not given.
    """
    leaves = Leaves(model)
    shared = rows.sparkSession.sparkContext.broadcast(leaves)
    place = len(leaves.base) - 1 if output is None else output
    base, labels = float(leaves.base[place]), list(names)
    kind = rows.schema[key].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = shared.value.cells(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], ["key", "cell"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS):
                cells = batch.column(0).slice(at, CELLS)
                x = np.stack([np.frombuffer(c.as_py()) for c in cells])
                found = shared.value.values(x, slice(place, place + 1))[:, :, 0]
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([cells, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["cell", "values"])

    vectors = rows.select(F.col(key).alias("key"), vector_to_array("features").alias("x"))
    known = materialise(vectors.mapInArrow(placed, f"key {kind}, cell binary"), "cells")
    distinct = known.select("cell").distinct()
    # Few cells are much work, as a task goes through all leaves: one task for each core, more for many cells.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, distinct.count() // (8 * CELLS))
    found = materialise(distinct.repartition(parts, "cell").mapInArrow(run, "cell binary, values array<double>"), "cell-values")
    each = F.inline(F.arrays_zip(F.array(*[F.lit(n) for n in labels]).alias("feature"), F.col("values").alias("value")))
    return known.join(found, "cell").select(F.col("key").alias(key), each).withColumn("base", F.lit(base))


def attribution_global(model, rows: DataFrame, key: str, names: Sequence[str], output: int | None = None) -> DataFrame:
    """``(feature, mean_abs)``: mean size of the features' values over all rows."""
    return tree_attribution(model, rows, key, names, output).groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
