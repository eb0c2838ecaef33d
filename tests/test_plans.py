"""The distributed building blocks against brute force, with a hot key holding most rows."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow.parquet as parquet
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.operators import profile
from sondage.plans import comoments, durable, neighbours, ordering, quantiles


def skewed(spark, n=3000, seed=1):
    """Two thirds of the rows share one group and a third of the values are equal."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n)),
        "v": np.where(rng.random(n) < 0.33, 7.0, np.round(rng.exponential(20, n), 2)),
    })
    frame.loc[frame.index % 50 == 0, "g"] = None
    return frame, spark.createDataFrame(frame).repartition(5)


def test_number_rows_matches_sort(spark):
    frame, df = skewed(spark)
    got = ordering.number_rows(df, ["v", "id"], ["g"]).toPandas()
    frame["g"] = frame["g"].fillna("~")
    want = frame.sort_values(["v", "id"]).assign(rn=lambda x: x.groupby("g").cumcount() + 1)
    merged = got.merge(want[["id", "rn"]], on="id", suffixes=("", "_want"))
    assert len(merged) == len(frame) and (merged["rn"] == merged["rn_want"]).all()


def test_number_rows_without_group(spark):
    frame, df = skewed(spark)
    got = ordering.number_rows(df, [F.col("v").desc(), "id"]).toPandas().sort_values("rn")
    want = frame.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert got["id"].tolist() == want and got["rn"].tolist() == list(range(1, len(frame) + 1))


@pytest.mark.parametrize("small", [10**9, 0])
def test_cumulative_small_and_distributed_agree(spark, small):
    frame, df = skewed(spark)
    collapsed = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = ordering.cumulative(collapsed, ["v"], ["g"], {"upto": "n"}, {"top": "m"}, small_rows=small).toPandas()
    for _, part in got.fillna({"g": "~"}).groupby("g"):
        part = part.sort_values("v")
        assert (part["n"].cumsum() == part["upto"]).all()
        assert (part["m"].cummax() == part["top"]).all()


def test_trailing_window_crosses_blocks(spark):
    frame, df = skewed(spark)
    rows, window = ordering.trailing(df, ["id"], ["g"], 10, block=25)
    got = rows.select("id", "g", F.sum("v").over(window).alias("s"), "_context").where(~F.col("_context")).toPandas()
    frame["g"] = frame["g"].fillna("~")
    want = frame.sort_values("id").groupby("g")["v"].rolling(10, min_periods=1).sum().reset_index(level=0, drop=True)
    merged = got.set_index("id")["s"].sort_index()
    assert len(merged) == len(frame)
    assert np.allclose(merged.to_numpy(), want.sort_index().to_numpy())


def test_hash_ranks_are_a_permutation_per_group(spark):
    frame, df = skewed(spark)
    got = ordering.hash_ranks(df, "id", 42, ["g"], digits=1).toPandas()
    for _, part in got.fillna({"g": "~"}).groupby("g"):
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))
        assert (part["group_size"] == len(part)).all()
    again = ordering.hash_ranks(df.repartition(3), "id", 42, ["g"], digits=3).toPandas()
    assert got.set_index("id")["rn"].sort_index().equals(again.set_index("id")["rn"].sort_index())


@pytest.mark.parametrize("discrete", [False, True])
def test_bracketed_quantiles_are_exact(spark, discrete):
    frame, df = skewed(spark, 5000)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    long = df.withColumn("g", F.coalesce("g", F.lit("~")))
    got = quantiles.exact_quantiles(long, ["g"], "v", probs, discrete, buffer_rows=0, accuracy=200)
    found = {r["g"]: r["q"] for r in got.collect()}
    frame["g"] = frame["g"].fillna("~")
    for g, part in frame.groupby("g"):
        method = "inverted_cdf" if discrete else "linear"
        assert np.allclose(found[g], np.quantile(part["v"], probs, method=method)), g


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.sampled_from([0.05, 0.25, 0.5, 0.9]))
def test_both_quantile_paths_agree(spark, values, p):
    df = spark.createDataFrame([("x", float(v)) for v in values], "g string, v double")
    small = quantiles.exact_quantiles(df, ["g"], "v", [p]).first()["q"][0]
    large = quantiles.exact_quantiles(df, ["g"], "v", [p], buffer_rows=0, accuracy=100).first()["q"][0]
    assert np.isclose(small, large, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("mode", ["plain", "self", "folds", "same"])
def test_nearest_equals_brute_force(spark, mode):
    rng = np.random.default_rng(3)
    n = 400
    points = np.round(rng.normal(size=(n, 3)), 2)
    points[: n // 3] = np.round(points[: n // 3] * 0.01, 3)  # a dense third around the origin
    points[n // 3: 2 * n // 3] = points[n - 1]  # a third of the rows are copies of one vector
    fold = rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, points[i].tolist(), int(fold[i])) for i in range(n)], "id long, vec array<double>, fold long")
    options = {
        "plain": {}, "self": {"exclude_self": True}, "folds": {"group": "fold"},
        "same": {"group": "fold", "same_group": True, "exclude_self": True},
    }[mode]
    got = neighbours.nearest(df, df, 4, "id", "vec", block_rows=60, **options).toPandas()
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), neighbours.TIE_DIGITS)
    if options.get("exclude_self"):
        np.fill_diagonal(d, np.inf)
    if "group" in options:
        equal = fold[:, None] == fold[None]
        d[~equal if options.get("same_group") else equal] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    for q, part in got.sort_values("rank").groupby("query"):
        assert part["neighbour"].tolist() == want[q].tolist()
    assert len(got) == 4 * n


def test_nearest_writes_in_proportion_to_its_input(spark, tmp_path, monkeypatch):
    """Wide vectors that hardly cluster meet in every pair of blocks, but no vector is written per pair."""
    rng = np.random.default_rng(4)
    n, width = 2000, 24
    points = rng.normal(size=(n, width))
    df = spark.createDataFrame([(f"k{i:04}", points[i].tolist()) for i in range(n)], "id string, vec array<double>").repartition(4)
    monkeypatch.setattr(durable, "scratch_dir", lambda session: str(tmp_path))
    got = neighbours.nearest(df, df, 3, "id", "vec", exclude_self=True, block_rows=100).toPandas()
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), neighbours.TIE_DIGITS)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    for q, part in got.sort_values("rank").groupby("query"):
        assert part["neighbour"].tolist() == [f"k{i:04}" for i in want[int(q[1:])]]
    assert len(got) == 3 * n
    assert sum(parquet.read_metadata(f).num_rows for f in tmp_path.rglob("*.parquet")) < 6 * n


def test_rows_that_come_twice_ask_together(spark):
    """Copies with one key in two folds have one list of answers, which each copy gets."""
    rows = [(i, [float(i)], f) for i in range(40) for f in ((i % 3, i % 3) if i % 2 else (0, 1))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, fold long")
    got = neighbours.nearest(df, df, 2, "id", "vec", group="fold", block_rows=16).toPandas()
    assert len(got) == 2 * len(rows)
    assert got[got["query"] == 0].sort_values("rank")["neighbour"].tolist() == [0, 0, 0, 0]


def test_nearest_keeps_a_key_with_fields(spark):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "n long, vec array<double>")
    base = base.select(F.struct("n", (F.col("n") * 10).alias("label")).alias("id"), "vec")
    asked = spark.range(300).select(F.struct("id").alias("id"), F.array((F.col("id") % 6).cast("double") + 0.5).alias("vec"))
    got = neighbours.nearest(asked, base, 2, "id", "vec", block_rows=50)
    found = {(r["query"]["id"], r["rank"]): r["neighbour"]["label"] for r in got.collect()}
    assert len(found) == 600
    for i in range(300):
        assert [found[i, 1], found[i, 2]] == ([50, 40] if i % 6 == 5 else [i % 6 * 10, i % 6 * 10 + 10])


def test_nearest_with_few_or_no_base_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vec array<double>")
    assert neighbours.nearest(df, df, 5, "id", "vec", exclude_self=True).count() == 2
    assert neighbours.nearest(df, df.where("id > 5"), 5, "id", "vec").count() == 0


def test_scratch_folder_comes_from_the_session():
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "/shared/scratch/"))
    assert durable.scratch_dir(named) == "/shared/scratch"


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.scratch_dir(bare)


def test_materialise_reads_back_what_was_written(spark):
    kept = durable.materialise(spark.range(10).withColumn("a", F.array(F.col("id"))), "probe")
    assert kept.count() == 10 and kept.schema["a"].dataType.simpleString() == "array<bigint>"


@pytest.mark.parametrize("discrete", [False, True])
@pytest.mark.parametrize("limits", [(2048, 1_000_000), (64, 500), (8, 20), (2, 0)])
def test_column_quantiles_close_in_exactly(spark, discrete, limits):
    rng = np.random.default_rng(5)
    n = 4000
    frame = pd.DataFrame({
        "heavy": np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(3, 4, n)), "ints": rng.integers(-5, 5, n).astype(float),
        "wide": rng.choice([-1.7e308, 1e-300, 3.0, 1.7e308], n), "constant": 2.5, "holes": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
        "infinite": np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.normal(size=n))),
    })
    frame["nothing"] = np.nan
    df = spark.createDataFrame(frame).repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9995, 1.0]
    got = quantiles.column_quantiles(df, list(frame.columns), probs, discrete, *limits)
    assert "nothing" not in got
    method = "inverted_cdf" if discrete else "linear"
    for c in ("heavy", "ints", "constant", "holes") + (("wide", "infinite") if discrete else ()):
        want = np.quantile(frame[c].dropna(), probs, method=method)
        assert np.allclose(got[c], want, rtol=1e-12), c


@pytest.mark.parametrize("tile", [2, 512])
def test_comoments_equal_numpy_over_rows_that_have_both(spark, monkeypatch, tile):
    monkeypatch.setattr(comoments, "TILE", tile)
    rng = np.random.default_rng(4)
    data = rng.normal(1e6, 3, (300, 5))
    data[:, 1] += data[:, 0]
    data[:, 3] = 0.1
    data[rng.random((300, 5)) < 0.3] = np.nan
    data[:, 4] = np.where(np.isnan(data[:, 0]), 5.0, np.nan)
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in data]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    got = {(r["i"], r["j"]): r for r in comoments.comoments(df, {c: F.col(c) for c in df.columns}).collect()}
    assert set(got) == {(i, j) for i in range(5) for j in range(i, 5)}
    for (i, j), r in got.items():
        both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
        assert r["n"] == both.sum()
        if not both.any():
            assert r["cov"] is None
            continue
        x, y = data[both, i], data[both, j]
        assert r["var_a"] == pytest.approx(x.var() if i not in (3, 4) else 0.0, rel=1e-9)
        assert r["cov"] == pytest.approx(((x - x.mean()) * (y - y.mean())).mean(), rel=1e-6, abs=1e-9)
    assert comoments.comoments(df.limit(0), {"a": F.col("a"), "b": F.col("b")}).count() == 3


def test_all_pairs_of_many_columns_take_one_scan(spark):
    df = spark.range(100).select(*[(F.rand(i) * F.col("id")).alias(f"f{i}") for i in range(40)])
    pairs = profile.correlations(df, df.columns)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 2 and "Join" not in text and text.count("Range") == 2
    assert pairs.count() == 780


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_rows_by_hash_and_then_whole(spark, monkeypatch, collide):
    """With ``collide``, many different rows share both hashes."""
    if collide:
        monkeypatch.setattr(profile, "row_hash", lambda df: [F.pmod(F.xxhash64(*df.columns), F.lit(3)), F.lit(1)])
    rows = [(i % 50, None if i % 3 else f"t{i % 20}", float(i % 4) if i % 5 else float("nan")) for i in range(400)] + [(1000 + i, "u", 0.0) for i in range(9)]
    rows += [(2000, "z", 0.0), (2000, "z", -0.0)]
    df = spark.createDataFrame(rows, "a int, `b c` string, d double")
    assert profile.duplicate_rows(df).first()[0] == df.count() - df.distinct().count()
    got = profile.fingerprint(df).first()
    assert (got["n_rows"], got["duplicate_rows"]) == (df.count(), df.count() - df.distinct().count())
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0


def test_duplicates_shuffle_hashes_not_rows(spark, tmp_path):
    """Rows of a thousand characters, none repeated: the shuffle holds some bytes a row."""
    df = spark.range(20000).select("id", F.repeat(F.col("id").cast("string"), 200).alias("wide"))
    df.write.parquet(str(tmp_path / "wide"))
    plan = profile.repeated_rows(spark.read.parquet(str(tmp_path / "wide")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and plan.count() == 0
