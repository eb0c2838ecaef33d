"""Landmarks of many datasets at once against plain NumPy, dataset by dataset."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sondage.operators import grouped

FEATURES = ["a", "b", "c"]
SCHEMA = "ds string, id long, a double, b double, c string, y string"


def rows(seed=3):
    """A separable dataset, noise with many ties and gaps, three classes, one class, and one too small to score."""
    rng = random.Random(seed)
    out = []
    for i in range(90):
        y = rng.choice("pq")
        out.append(("one", i, rng.gauss(3 if y == "p" else 0, 1), rng.random(), rng.choice("uv"), y))
    for i in range(90, 150):
        out.append((None, i, rng.choice([1.0, 2.0, None]), None, rng.choice(["u", None]), rng.choice("pq")))
    for i in range(150, 260):
        y = rng.choice("pqr")
        out.append(("three", i, {"p": 0, "q": 3, "r": 6}[y] + rng.gauss(0, 1.5), rng.choice([0.0, float("nan"), 1.0]), "w", y if rng.random() < 0.9 else None))
    out += [("flat", 260 + i, 1.0, 2.0, "x", "p") for i in range(9)] + [("tiny", 270 + i, float(i), 0.0, "x", "pq"[i]) for i in range(2)]
    return out


def f1(truth, guess):
    total = 0.0
    for c in set(truth):
        tp = sum(t == g == c for t, g in zip(truth, guess))
        total += 2 * tp / (truth.count(c) + guess.count(c)) * truth.count(c)
    return total / len(truth)


def brute(part, fold):
    """Scores of one dataset: part is (id, y, x) with imputed and scaled x."""
    ids, y, x = [p[0] for p in part], np.array([p[1] for p in part]), np.array([p[2] for p in part])
    f = np.array([fold[i] for i in ids])
    out = {"dt": [], "nb": [], "knn": [], "svm": []}
    for g in range(3):
        tr, te = f != g, f == g
        if not te.any():
            continue
        guesses = {}
        best = None
        for j in range(x.shape[1]):
            for cut in sorted(set(x[tr, j]))[:-1]:
                sides = [y[tr & (x[:, j] <= cut)], y[tr & (x[:, j] > cut)]]
                purity = round(sum(sum(n * n for n in Counter(s).values()) / len(s) for s in sides) / tr.sum(), 6)
                if best is None or purity > best[0]:
                    best = purity, j, cut
        _, j, cut = best or (0, 0, math.inf)
        vote = {side: min(Counter(y[tr & ((x[:, j] <= cut) == side)]).items(), key=lambda kv: (-kv[1], kv[0]))[0]
                for side in (True, False) if (tr & ((x[:, j] <= cut) == side)).any()}
        guesses["dt"] = [vote[bool(v <= cut)] for v in x[te, j]]
        floor = 1e-9 * x[tr].var(axis=0).max()
        level = {}
        for c in sorted(set(y[tr])):
            part_x = x[tr & (y == c)]
            var = np.maximum(part_x.var(axis=0) + floor, 1e-300)
            level[c] = math.log(len(part_x) / tr.sum()) - 0.5 * np.log(var).sum() - ((x[te] - part_x.mean(axis=0)) ** 2 * 0.5 / var).sum(axis=1)
        guesses["nb"] = [max(sorted(level), key=lambda c: level[c][i]) for i in range(te.sum())]
        near = []
        for v in x[te]:
            d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
            order = sorted(np.flatnonzero(tr), key=lambda i: (d[i], ids[i]))[:3]
            near.append(min(Counter(y[order]).items(), key=lambda kv: (-kv[1], kv[0]))[0])
        guesses["knn"] = near
        names = sorted(set(y))
        one = np.hstack([x, np.ones((len(x), 1))])
        values = []
        for c in names if len(names) > 2 else names[1:]:
            t, w = np.where(y[tr] == c, 1.0, -1.0), np.zeros(one.shape[1])
            for _ in range(20000):
                slack = np.maximum(1 - t * (one[tr] @ w), 0)
                w -= 0.5 / (1 + 2 * (one[tr] ** 2).sum()) * (w - 2 * one[tr].T @ (t * slack))
            values.append(one[te] @ w)
        guesses["svm"] = [names[i] for i in (np.argmax(values, axis=0) if len(values) > 1 else (values[0] > 0).astype(int))]
        for name, guess in guesses.items():
            out[name].append(f1(list(y[te]), list(guess)))
    return {k: float(np.mean(v)) for k, v in out.items()}


def test_landmarks_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(grouped, "BLOCK_ROWS", 40)
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["ds"]: r.asDict() for r in grouped.landmarks(df, "ds", "id", FEATURES, "y").collect()}
    assert set(got) == {"one", None, "three", "flat", "tiny"}
    fold = {r["key"]: r["fold"] for r in grouped.prepared(df, "ds", "id", FEATURES, "y").collect()}
    for ds in ("one", None, "three"):
        part = [r for r in rows() if r[0] == ds and r[5] is not None]
        x = np.array([[np.nan if v is None else v for v in r[2:4]] + [0.0] for r in part], dtype=float)
        texts = sorted({r[4] or "missing" for r in part})
        x[:, 2] = [texts.index(r[4] or "missing") for r in part]
        for j in range(3):
            known = x[~np.isnan(x[:, j]), j]
            x[np.isnan(x[:, j]), j] = np.median(known) if len(known) else 0.0
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        expected = brute([(r[1], r[5], v) for r, v in zip(part, x)], fold)
        for name, column in grouped.NAMES.items():
            assert got[ds][column] == pytest.approx(expected[name], abs=1e-9), (ds, name)
    assert [got["flat"][c] for c in grouped.NAMES.values()] == [1.0, 1.0, 1.0, 0.0]
    assert [got["tiny"][c] for c in grouped.NAMES.values()] == [0.0] * 4


def test_folds_are_stratified(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    per = defaultdict(Counter)
    for r in grouped.prepared(df, "ds", "id", FEATURES, "y").collect():
        per[r["set"], r["y"]][r["fold"]] += 1
    assert all(max(c[f] for f in range(3)) - min(c[f] for f in range(3)) <= 1 for c in per.values())


def test_three_hundred_classes(spark):
    data = [("d", i, float(i // 6), 0.0, "x", f"c{i // 6:03}") for i in range(1800)]
    got = grouped.landmarks(spark.createDataFrame(data, SCHEMA), None, "id", ["a"], "y").first()
    assert got["l4_landmark_knn"] == 1.0 and 0 < got["l4_landmark_dt"] < 0.02 and got["l4_landmark_nb"] > 0.99
