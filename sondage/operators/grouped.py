"""Landmarks of many datasets at once, each a group of rows of one table.

Nothing loops over datasets.  Four very simple learners are scored by
cross-validation from sufficient statistics keyed by dataset, fold and class:

* Gaussian naive Bayes from sums and squares; a training fold is the total less the held-out part.
* A decision stump from running counts over the sorted values.  Classes are rows, so
  their number is free: the squares that make up the Gini purity change by a known amount with every
  counted cell, and running sums of those changes price every cut.
* A linear support vector machine with squared hinge loss by Newton steps: every step
  adds up one matrix and one vector per (dataset, fold, class) over the blocks of rows and solves them.
* The three nearest neighbours by the exact pivot join; a place of its own in the vector
  keeps datasets apart.

As in the characteriser these follow, categories become the rank of their text, missing
values the median, and columns are scaled, over all rows of a dataset with a target.  Folds are
stratified by class and repeatable.  A dataset none of whose classes has a row for each fold scores 0,
and so does one without a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.schema import numeric_columns
from sondage.operators.profile import clean, union_all
from sondage.plans.durable import materialise
from sondage.plans.neighbours import nearest
from sondage.plans.ordering import cumulative, hash_ranks, number_rows
from sondage.plans.quantiles import exact_quantiles

FOLDS = 3
NEIGHBOURS = 3
SMOOTHING = 1e-9
#: Rows of a block of the support vector machine, its cost of a violation and its Newton steps at most.
BLOCK_ROWS, COST, STEPS = 4096, 1.0, 30
#: Further apart than two scaled rows of one dataset can be.
APART = 1e7
PURITY_DIGITS = 6
NAMES = {"dt": "l4_landmark_dt", "nb": "l4_landmark_nb", "knn": "l4_landmark_knn", "svm": "l4_landmark_svm"}


def _set(dataset: Column) -> Column:
    return F.coalesce(F.concat(F.lit("d"), dataset.cast("string")), F.lit("n"))


def rank_codes(df: DataFrame, column: str, within: Sequence[str] = ("set",)) -> DataFrame:
    """``(within..., column, code)``: each text's place among the distinct ones of its group, from 0."""
    values = df.select(*within, column).distinct()
    return number_rows(values, [column], list(within), "code").withColumn("code", (F.col("code") - 1).cast("double"))


def prepared(df: DataFrame, dataset: str | None, key: str, features: Sequence[str], target: str, folds: int = FOLDS) -> DataFrame:
    """``(set, key, y, fold, x)``: rows with a target, imputed and scaled features, written once."""
    numeric = set(numeric_columns(df))
    place = {f: f"x{i}" for i, f in enumerate(features)}
    rows = df.where(F.col(target).isNotNull()).select(
        _set(F.col(dataset) if dataset else F.lit("")).alias("set"), F.col(key).alias("key"), F.col(target).cast("string").alias("y"),
        *[(clean(f).cast("double") if f in numeric else F.coalesce(F.col(f).cast("string"), F.lit("missing"))).alias(n)
          for f, n in place.items()])
    ranked = hash_ranks(rows, "key", 42, ["set", "y"], size_name=None)
    rows = materialise(ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")).drop("rn"), "folds")
    for f, n in place.items():
        if f not in numeric:
            codes = materialise(rank_codes(rows, n), "codes")
            rows = rows.join(codes, ["set", n]).drop(n).withColumnRenamed("code", n)
    names = list(place.values())
    items = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("value")) for n in names])
    middle = exact_quantiles(rows.select("set", F.inline(items)), ["set", "f"], "value", [0.5])
    medians = middle.groupBy("set").agg(F.map_from_entries(F.collect_list(F.struct("f", F.col("q")[0].alias("q")))).alias("m"))
    filled = materialise(rows.join(medians, "set", "left").select("set", "key", "y", "fold", *[
        F.coalesce(n, F.try_element_at("m", F.lit(n)), F.lit(0.0)).alias(n) for n in names]), "filled")
    facts = filled.groupBy("set").agg(*[e for n in names for e in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))])
    scaled = [(F.col(n) - F.col(f"m_{n}")) / F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(1.0) for n in names]
    return materialise(filled.join(facts, "set").select("set", "key", "y", "fold", F.array(*scaled).cast("array<double>").alias("x")), "scaled")


def _training(cells: DataFrame, keys: Sequence[str], sums: Sequence[str], folds: int) -> DataFrame:
    """``cells (fold, ...)`` as ``(g, keys, sums)``: for each held-out fold g the sums of the others."""
    others = F.explode(F.filter(F.array(*[F.lit(g) for g in range(folds)]), lambda g: g != F.col("fold"))).alias("g")
    return cells.select(others, *keys, *sums).groupBy("g", *keys).agg(*[F.sum(s).alias(s) for s in sums])


def fold_f1(cells: DataFrame) -> DataFrame:
    """``(set, fold, f1)``: weighted F1 from counted ``(set, fold, y, y_hat, n)``."""
    match = F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), match.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("y_hat").alias("c"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("predicted")))
    per = cells.select("set", "fold", F.inline(sides)).groupBy("set", "fold", "c").agg(
        *[F.sum(s).alias(s) for s in ("support", "tp", "predicted")])
    f1 = F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("predicted"))
    return per.groupBy("set", "fold").agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def _f1(cells: DataFrame) -> DataFrame:
    return fold_f1(cells).groupBy("set").agg(F.avg("f1").alias("f1"))


def _counted(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("set", "fold", "y", "y_hat").agg(F.count(F.lit(1)).alias("n"))


def naive_bayes(rows: DataFrame, width: int, folds: int = FOLDS) -> DataFrame:
    """``(set, f1)``; the features are centred over the dataset, which keeps the variances accurate."""
    sums = [f"s{j}" for j in range(width)] + [f"q{j}" for j in range(width)]
    cells = rows.groupBy("set", "fold", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)],
        *[F.sum(F.col("x")[j] * F.col("x")[j]).alias(f"q{j}") for j in range(width)])
    classes = _training(cells, ["set", "y"], ["n", *sums], folds)
    whole = classes.groupBy("set", "g").agg(F.sum("n").alias("total"), F.greatest(*[
        F.sum(f"q{j}") / F.sum("n") - F.pow(F.sum(f"s{j}") / F.sum("n"), 2) for j in range(width)], F.lit(0.0)).alias("widest"))
    joined = classes.join(whole, ["set", "g"])
    mean = F.array(*[F.col(f"s{j}") / F.col("n") for j in range(width)])
    floor = F.lit(SMOOTHING) * F.col("widest")
    variance = [F.greatest(F.greatest(F.col(f"q{j}") / F.col("n") - F.pow(F.col(f"s{j}") / F.col("n"), 2), F.lit(0.0)) + floor, F.lit(1e-300))
                for j in range(width)]
    level = F.log(F.col("n") / F.col("total")) - sum((F.log(v) for v in variance), F.lit(0.0)) * 0.5
    model = joined.select("set", "g", F.struct(
        "y", level.alias("level"), mean.alias("mean"), F.array(*[F.lit(0.5) / v for v in variance]).alias("half")).alias("c"))
    model = materialise(model.groupBy("set", "g").agg(F.collect_list("c").alias("classes")), "nb")

    def score(c):
        squares = F.zip_with("x", c["mean"], lambda v, m: (v - m) * (v - m))
        return c["level"] - F.aggregate(F.zip_with(squares, c["half"], lambda q, h: q * h), F.lit(0.0), lambda a, t: a + t)

    scored = rows.join(model.withColumnRenamed("g", "fold"), ["set", "fold"])
    # On a tie the first class in order wins.
    best = F.aggregate(
        F.transform("classes", lambda c: F.struct(score(c).alias("s"), c["y"].alias("y"))),
        F.lit(None).cast("struct<s:double,y:string>"),
        lambda a, c: F.when(a.isNull() | (c["s"] > a["s"]) | ((c["s"] == a["s"]) & (c["y"] < a["y"])), c).otherwise(a))
    return _f1(_counted(scored.select("set", "fold", "y", best["y"].alias("y_hat"))))


def stump(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``(set, f1)``: one cut at a data value per training fold, by weighted Gini; ties take the first feature and the lowest cut."""
    cells = materialise(
        rows.select("set", "fold", "y", F.posexplode("x").alias("j", "value")).groupBy("set", "j", "value", "fold", "y").agg(
            F.count(F.lit(1)).alias("n")), "cells")
    train = _training(cells, ["set", "j", "value", "y"], ["n"], folds)
    return _f1(stump_cells(train, cells))


def stump_cells(train: DataFrame, held: DataFrame, relative: bool = True) -> DataFrame:
    """Counted ``(set, fold, y, y_hat, n)`` of the stumps fitted on ``train (g, set, j, value, y, n)`` for ``held (set, fold, j, value, y, n)``.

    Every row has a value of every feature.  Purities that agree in ``PURITY_DIGITS`` places are ties; ``relative`` takes
    them per row.
    """
    totals = train.where("j = 0").groupBy("set", "g", "y").agg(F.sum("n").alias("every"))
    sides = cumulative(train, ["value"], ["set", "j", "g", "y"], {"upto": "n"})
    # From L to L + n rows of a class on the left: its square grows by 2 L n + n^2, that of the right changes likewise.
    n, before = F.col("n").cast("double"), (F.col("upto") - F.col("n")).cast("double")
    changes = sides.join(totals, ["set", "g", "y"]).groupBy("set", "j", "g", "value").agg(
        F.sum("n").alias("n"), F.sum(2 * before * n + n * n).alias("left"), F.sum(n * n - 2 * (F.col("every") - before) * n).alias("right"))
    priced = cumulative(changes, ["value"], ["set", "j", "g"], {"n_left": "n", "on_left": "left", "off_right": "right"})
    whole = totals.groupBy("set", "g").agg(F.sum("every").alias("total"), F.sum(F.col("every").cast("double") * F.col("every")).alias("squares"))
    n_left = F.col("n_left").cast("double")
    purity = F.col("on_left") / n_left + (F.col("squares") + F.col("off_right")) / (F.col("total") - n_left)
    cuts = priced.join(whole, ["set", "g"]).where(F.col("n_left") < F.col("total")).groupBy("set", "g").agg(
        F.min_by(F.struct("j", "value"), F.struct(-F.round(purity / (F.col("total") if relative else F.lit(1)), PURITY_DIGITS), F.col("j"), F.col("value"))).alias("b"))
    # Features that never vary leave one side.
    cuts = materialise(totals.select("set", "g").distinct().join(cuts, ["set", "g"], "left").select(
        "set", "g", F.coalesce("b.j", F.lit(0)).alias("j"), F.coalesce("b.value", F.lit(float("inf"))).alias("cut")), "cuts")
    left = (F.col("value") <= F.col("cut")).alias("left")
    votes = train.join(cuts, ["set", "g", "j"]).groupBy("set", "g", left, "y").agg(F.sum("n").alias("n"))
    winner = votes.groupBy("set", "g", "left").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("y_hat"))
    asked = held.join(cuts.withColumnRenamed("g", "fold"), ["set", "fold", "j"]).select("set", "fold", left, "y", "n")
    return asked.join(winner.withColumnRenamed("g", "fold"), ["set", "fold", "left"]).groupBy("set", "fold", "y", "y_hat").agg(
        F.sum("n").alias("n"))


def neighbours(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(set, f1)``: vote of the nearest rows of the other folds of the same dataset, ties to the first class in order."""
    sets = number_rows(rows.select("set").distinct(), ["set"], name="place")
    views = rows.join(sets, "set").select("key", "set", "y", "fold", F.concat("x", F.array(F.col("place") * F.lit(APART))).alias("vec"))
    views = materialise(views, "knn-views")
    near = nearest(views, views, k, "key", "vec", group="fold")
    known = views.select(F.col("key").alias("neighbour"), F.col("set").alias("other"), F.col("y").alias("vote"))
    asked = views.select(F.col("key").alias("query"), "set", "fold", "y")
    votes = near.join(known, "neighbour").join(asked, "query").where("set = other").groupBy("query", "set", "fold", "y", "vote").agg(
        F.count(F.lit(1)).alias("n"))
    return _f1(_counted(votes.groupBy("query", "set", "fold", "y").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("y_hat"))))


def support_vectors(rows: DataFrame, width: int, folds: int = FOLDS) -> DataFrame:
    """``(set, f1)``: one linear machine per training fold and class, squared hinge loss, the constant penalised like a weight."""
    sizes = rows.groupBy("set").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    classes = rows.select("set", "y").distinct()
    codes = materialise(rank_codes(classes.withColumnRenamed("y", "label"), "label").withColumnRenamed("label", "y"), "classes")
    numbers = codes.groupBy("set").agg(F.count(F.lit(1)).alias("classes"))
    # Two classes need one machine.
    several = materialise(numbers.select("set", F.when(F.col("classes") > 2, F.col("classes")).otherwise(1).cast("int").alias("machines")), "machines")
    packed = rows.join(codes, ["set", "y"]).join(sizes, "set").groupBy(
        "set", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("fold", F.col("code").cast("int").alias("code"), "x")).alias("rows"))
    packed = materialise(packed.join(several, "set").select("set", "machines", "rows"), "blocks")
    size = width + 1

    def unpack(batch, i):
        found = batch.column(2)[i].values
        x = found.field("x").flatten().to_numpy().reshape(len(found), width)
        return found.field("fold").to_numpy(), found.field("code").to_numpy(), np.hstack([x, np.ones((len(x), 1))])

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                fold, code, x = unpack(batch, i)
                machines = batch.column(1)[i].as_py()
                before = batch.column(3)[i].as_py() or [None] * (folds * machines)
                out = []
                for at, w in enumerate(before):
                    g, c = divmod(at, machines)
                    y = np.where(code == (c if machines > 1 else 1), 1.0, -1.0)
                    off = np.maximum(1 - y * (x @ np.array(w)), 0) if w else np.ones(len(x))
                    active = (fold != g) & (off > 0)
                    a = x[active]
                    out.append((at, (a.T @ a).ravel(), a.T @ y[active], float((off[active] ** 2).sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(out)), pa.array([o[0] for o in out], pa.int32()),
                     pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.list_(pa.float64())),
                     pa.array([o[3] for o in out])], ["set", "at", "matrix", "vector", "loss"])

    @F.arrow_udf("array<double>")
    def solve(matrix: pa.Array, vector: pa.Array) -> pa.Array:
        out = []
        for m, v in zip(matrix, vector):
            m = np.eye(size) + 2 * COST * m.values.to_numpy().reshape(size, size)
            out.append(np.linalg.solve(m, 2 * COST * v.values.to_numpy()))
        return pa.array(out, pa.list_(pa.float64()))

    def total(name, n):
        return F.array(*[F.sum(F.col(name)[j]) for j in range(n)])

    kinds = "`set` string, at int, matrix array<double>, vector array<double>, loss double"
    models = several.select("set", F.lit(None).cast("array<array<double>>").alias("w"))
    best = None
    for _ in range(STEPS):
        sums = packed.join(models, "set").select("set", "machines", "rows", "w").mapInArrow(step, kinds)
        sums = sums.groupBy("set", "at").agg(total("matrix", size * size).alias("matrix"), total("vector", size).alias("vector"), F.sum("loss").alias("loss"))
        priced = sums.join(models, "set", "left").select("set", "at", "matrix", "vector", "loss", F.get("w", F.col("at")).alias("w"))
        found = materialise(priced.select("set", "at", "loss", "w", solve("matrix", "vector").alias("next")), "svm")
        # The best weights so far stay: full steps need not go down every time.
        norm = F.aggregate(F.transform("w", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
        here = found.select("set", "at", "w", "next", F.when(F.col("w").isNotNull(), norm / 2 + COST * F.col("loss")).alias("price"))
        if best is not None:
            old = best.select("set", "at", F.col("price").alias("old_price"), F.col("best").alias("old"))
            here = here.join(old, ["set", "at"])
            better = F.col("old_price").isNull() | (F.col("price") < F.col("old_price") * (1 - 1e-9))
            best = here.select("set", "at", "next", F.when(better, F.col("price")).otherwise(F.col("old_price")).alias("price"),
                               F.when(better, F.col("w")).otherwise(F.col("old")).alias("best"), better.alias("moved"))
        else:
            best = here.select("set", "at", "next", "price", F.col("w").alias("best"), F.lit(True).alias("moved"))
        best = materialise(best, "svm-best")
        if not best.where("moved").take(1):
            break
        weights = F.transform(F.array_sort(F.collect_list(F.struct("at", "next"))), lambda s: s["next"])
        models = materialise(best.groupBy("set").agg(weights.alias("w")), "svm-next")
    weights = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("best", "next").alias("w")))), lambda s: s["w"])
    models = best.groupBy("set").agg(weights.alias("w"))

    def predict(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                fold, code, x = unpack(batch, i)
                machines = batch.column(1)[i].as_py()
                w = np.array(batch.column(3)[i].as_py()).reshape(folds, machines, size)
                values = np.einsum("nd,nmd->nm", x, w[fold])
                guess = values.argmax(axis=1) if machines > 1 else (values[:, 0] > 0).astype(np.int64)
                pairs, n = np.unique(np.stack([fold, code, guess]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(n)), *[pa.array(p.astype(np.int32)) for p in pairs], pa.array(n.astype(np.int64))],
                    ["set", "fold", "y", "y_hat", "n"])

    cells = packed.join(models, "set").select("set", "machines", "rows", "w").mapInArrow(
        predict, "`set` string, fold int, y int, y_hat int, n long")
    return _f1(cells.groupBy("set", "fold", "y", "y_hat").agg(F.sum("n").alias("n")))


def landmarks(df: DataFrame, dataset: str | None, key: str, features: Sequence[str], target: str, folds: int = FOLDS) -> DataFrame:
    """``(dataset, l4_landmark_dt, l4_landmark_nb, l4_landmark_knn, l4_landmark_svm)`` per value of ``dataset``, or of the whole table."""
    every = df.select(F.col(dataset)).distinct().withColumn("set", _set(F.col(dataset))) if dataset else df.sparkSession.range(1).select(
        _set(F.lit("")).alias("set"))
    if not features:
        return every.drop("set").select("*", *[F.lit(0.0).alias(n) for n in NAMES.values()])
    rows = prepared(df, dataset, key, features, target, folds)
    usable = rows.groupBy("set", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("set").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("classes")).where(F.col("n") >= folds)
    rows = materialise(rows.join(usable.select("set", "classes"), "set").where("classes > 1").drop("classes"), "usable")
    single = usable.where("classes = 1").select("set")
    scores = {"dt": stump(rows, folds), "nb": naive_bayes(rows, len(features), folds), "knn": neighbours(rows),
              "svm": support_vectors(rows, len(features), folds)}
    # With one class there is nothing to get wrong, but a machine needs two.
    alone = {"dt": 1.0, "nb": 1.0, "knn": 1.0, "svm": 0.0}
    for name, found in scores.items():
        found = union_all([found, single.withColumn("f1", F.lit(alone[name]))])
        every = every.join(found.withColumnRenamed("f1", NAMES[name]), "set", "left")
    return every.select(*([dataset] if dataset else []), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in NAMES.values()])
