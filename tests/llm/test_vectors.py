"""Vector and code search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import hamming, permutations

SCHEMA = "vec_id long, embedding array<float>, rep string, query string, score int"


def vectors(seed=1, n=600, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    found = centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, dim))
    found[50:90] = found[3]
    rows = [(i, [float(np.float32(x)) for x in v], "r", "q", 1) for i, v in enumerate(found)]
    odd = [None, [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], []]
    rows += [(1000 + 20 * i, v, "r", "q", 1) for i, v in enumerate(odd)]
    return rows + [rows[20], (None, rows[20][1], "r", "q", 1)], found.astype(np.float32).astype(float)


def test_permutation_index_finds_most(spark):
    rows, found = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in permutations.search(df, df.where("vec_id % 20 = 0"), 20, pivots=64, posted=6, probed=24).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(600) if i % 20 == 0}
    hits = 0
    for q, answers in got.items():
        answers.sort()
        assert [a for a, _, _ in answers] == list(range(1, 21)) and q not in {v for _, v, _ in answers}
        scores = found @ found[q]
        scores[q] = -np.inf
        order = sorted(range(600), key=lambda i: (-scores[i], i))[:20]
        hits += len(set(order) & {v for _, v, _ in answers})
        assert [v for _, v, _ in answers] == [v for _, v, _ in sorted(answers, key=lambda a: (-a[2], a[1]))]
        assert all(s == pytest.approx(scores[v], abs=1e-9) for _, v, s in answers)
    assert hits / (20 * len(got)) >= 0.9


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], "", "", 0) for i in range(5)], SCHEMA)
    got = [tuple(r) for r in permutations.search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, i, i, 1.0) for i in range(1, 5)]


def test_hamming_search_is_exact(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) for _ in range(300)]
    codes += [codes[0]] * 40 + [codes[1] ^ (1 << rng.randrange(64)) for _ in range(60)]
    rows = [(i, c.to_bytes(8, "big"), "r", "q") for i, c in enumerate(codes)]
    bad = [(5000, None, "r", "q"), (5050, b"", "r", "q"), (5100, b"123", "r", "q"), (None, rows[0][1], "r", "q"), rows[50]]
    df = spark.createDataFrame(rows + bad, "vec_id long, code binary, rep string, score string")
    got = {}
    for r in hamming.search(df, df.where("vec_id % 50 = 0"), 10, "vec_id", "code").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(400) if i % 50 == 0}
    for q, answers in got.items():
        order = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:10]
        assert sorted(answers) == [(k + 1, i, d) for k, (d, i) in enumerate(order)]


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0] * 8), (2, [0.0] * 16), (3, [1.0]), (4, None), (5, [None] * 16)], "id int, v array<float>")
    got = {r[0]: r[1] for r in df.select("id", hamming.sign_code("v", 2)).collect()}
    assert got == {1: bytearray(b"\xaa\xaa"), 2: bytearray(b"\0\0"), 3: None, 4: None, 5: None}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert permutations.search(df, df, 5).count() == 0
    codes = df.select("vec_id", F.lit(None).cast("binary").alias("code"))
    assert hamming.search(codes, codes, 5, "vec_id", "code").count() == 0
