"""Shapley values of tree models against the sum over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor

from sondage.operators import treeshap

WIDTH = 5


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, WIDTH))
    x[:, 4] = rng.integers(0, 4, 300)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 4] == 2) + rng.normal(0, 0.4, 300) > 0.3).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v), float(r[0] * 2)) for i, (r, v) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, e double, label double, amount double")
    raw = VectorAssembler(inputCols=list("abcde"), outputCol="raw").transform(df)
    # The last column becomes categorical.
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(raw).transform(raw).cache()


def known_value(leaves, x, known):
    """Expectation with some features known, leaf by leaf."""
    total = 0.0
    for value, path in leaves.leaves:
        share = 1.0
        for f, (low, high, allowed, part) in path.items():
            share *= (float(low < x[f] <= high if allowed is None else x[f] in allowed)) if f in known else part
        total = total + share * value
    return total


def brute(leaves, x):
    out = []
    for j in range(WIDTH):
        rest, total = [f for f in range(WIDTH) if f != j], 0.0
        for size in range(WIDTH):
            for some in combinations(rest, size):
                weight = factorial(size) * factorial(WIDTH - size - 1) / factorial(WIDTH)
                total = total + weight * (known_value(leaves, x, {*some, j}) - known_value(leaves, x, set(some)))
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize(("kind", "settings"), [
    (DecisionTreeClassifier, {"maxDepth": 5}), (RandomForestClassifier, {"numTrees": 4, "maxDepth": 6, "seed": 1}),
    (GBTClassifier, {"maxIter": 3, "maxDepth": 3, "seed": 1}), (RandomForestRegressor, {"numTrees": 3, "maxDepth": 4, "labelCol": "amount", "seed": 1})])
def test_values_equal_the_sum_over_subsets(spark, table, kind, settings):
    model = kind(**settings).fit(table)
    leaves = treeshap.Leaves(model)
    rows = np.array([r[0] for r in table.orderBy("id").limit(12).select(vector_to_array("features")).collect()])
    got = leaves.values(rows)
    for x, found in zip(rows, got):
        assert np.allclose(found, brute(leaves, x), atol=1e-10)
    parts = treeshap.tree_attribution(model, table, "id", list("abcde")).collect()
    sums, base = {}, parts[0]["base"]
    for r in parts:
        sums[r["id"]] = sums.get(r["id"], base) + r["value"]
    scored = model.transform(table)
    if "GBT" in type(model).__name__:
        wanted = {r["id"]: r["rawPrediction"][1] for r in scored.collect()}
    elif "probability" in scored.columns:
        wanted = {r["id"]: r["probability"][1] for r in scored.collect()}
    else:
        wanted = {r["id"]: r["prediction"] for r in scored.collect()}
    assert set(sums) == set(wanted) and all(abs(sums[i] - wanted[i]) < 1e-9 for i in wanted)


def test_global_attribution_finds_what_matters(table):
    model = RandomForestClassifier(numTrees=10, maxDepth=5, seed=1).fit(table)
    found = {r["feature"]: r["mean_abs"] for r in treeshap.attribution_global(model, table, "id", list("abcde")).collect()}
    assert len(found) == WIDTH and max(found, key=found.get) == "a" and min(found, key=found.get) == "d"


def test_rows_between_the_same_cuts_are_worked_out_once(spark, table, monkeypatch):
    model = DecisionTreeClassifier(maxDepth=3, seed=1).fit(table)
    leaves = treeshap.Leaves(model)
    rows = np.array([r[0] for r in table.select(vector_to_array("features")).collect()])
    cells = leaves.cells(rows)
    assert len(np.unique(cells, axis=0)) < len(rows) / 2
    assert np.allclose(leaves.values(cells), leaves.values(rows), atol=1e-12)
    asked = []
    whole = treeshap.materialise
    monkeypatch.setattr(treeshap, "materialise", lambda df, label: asked.append((label, whole(df, label))) or asked[-1][1])
    assert treeshap.tree_attribution(model, table, "id", list("abcde")).count() == 300 * WIDTH
    assert dict(asked)["cell-values"].count() == len(np.unique(cells, axis=0))
