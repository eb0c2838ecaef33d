"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots, nearest (of largest inner
product) first.  It is posted in the inverted files of its ``POSTED`` first pivots; a query
looks into those of its ``PROBED`` first ones.  In a file the candidates are
ranked by footrule distance, the sum of the pivots' displacements, and the
first ``KEPT`` share of them is scored on the vectors themselves.  A candidate that is posted in several
of the files of a query counts in the first.

Pivots are a sample by hash; every vector is indexed.  Equal vectors are one
entry, so a vector that fills a third of the table costs no more than any other.  A
long file is dealt in blocks by hash, a block of candidates to each block of queries.

The four parameters trade recall for work; with vectors that hardly cluster a
fixed recall needs a fixed share of the table.

Defined results: vectors that are null, zero, hold null or non-finite
components, or are not of the most frequent length take no part, nor do rows without id; a repeated
id with the same vector counts once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.plans.durable import materialise

PIVOTS = 256
POSTED = 8
PROBED = 40
KEPT = 0.25
LEAST_KEPT = 64
BLOCK_ROWS = 4096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part, doubles, each once."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count()
    common = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0)).distinct()


def classes(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``(rep, <by>, ids)`` per distinct value: its smallest id and its ``most`` smallest ids."""
    order = F.row_number().over(W.partitionBy(by).orderBy("id"))
    first = rows.withColumn("_r", order).where(F.col("_r") <= most)
    return first.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), by, "ids")


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def ranked(found: DataFrame, groups: DataFrame, asked: DataFrame, k: int, nearest_first) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: classes become ids, queries of one class share an answer, none finds itself."""
    order = W.partitionBy("query").orderBy(nearest_first, "rep")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    every = best.join(groups.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(nearest_first, "vec_id")
    every = materialise(every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1), "answers")
    own = asked.join(every, "query").where(F.col("vec_id") != F.col("query_id"))
    order = W.partitionBy("query_id").orderBy("_r")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def blocks(side: DataFrame, cell: list[str], name: str) -> DataFrame:
    return side.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))


def dealt(left: DataFrame, right: DataFrame, cell: list[str], left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``lb`` and ``rb``: every block of one side meets every block of the other in its cell."""
    plan = blocks(left, cell, "ln").join(blocks(right, cell, "rn"), cell)

    def spread(side, key, own, own_n, other, other_n):
        return (
            side.join(plan, cell).withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("ln", "rn"))

    return spread(left, left_id, "lb", "ln", "rb", "rn"), spread(right, right_id, "rb", "rn", "lb", "ln")


def search(
    df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, kept: float = KEPT,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``df`` found of largest inner product with each row of ``queries``."""
    rows = materialise(usable(df, key, vector), "vectors")
    groups = materialise(classes(rows, "v", k + 1), "distinct")
    wanted = rows.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id")
    heads = wanted.groupBy("v").agg(F.min("id").alias("query"))
    asked = wanted.join(heads, "v").select("query", F.col("id").alias("query_id"))
    # At most ``pivots`` vectors reach the driver.
    chosen = groups.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").collect()
    places = _matrix([r["v"] for r in chosen]) if chosen else np.zeros((1, 1))
    # A long pivot must not come first for every vector.
    places = places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-300)
    count = len(places)
    posted, probed = min(posted, count), min(probed, count)
    kind = np.uint8 if count <= 256 else np.uint16

    def orders(take: int):
        def run(v: pd.Series) -> pd.DataFrame:
            order = np.argsort(-(_matrix(v) @ places.T), axis=1, kind="stable")
            position = np.empty(order.shape, dtype=kind)
            np.put_along_axis(position, order, np.arange(count, dtype=kind)[None, :].repeat(len(order), 0), 1)
            return pd.DataFrame({"order": [p.tobytes() for p in position], "files": list(order[:, :take].astype(np.int32))})

        return F.pandas_udf(run, "order binary, files array<int>")

    def posts(side, name, take):
        placed = side.select(name, "v", orders(take)("v").alias("p"))
        return placed.select(name, "v", "p.order", F.explode("p.files").alias("file"))

    entries = materialise(posts(groups, "rep", posted), "postings")
    probes = materialise(posts(heads, "query", probed), "probes")
    left, right = dealt(probes, entries, ["file"], "query", "rep")

    def compare(cell, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(e):
            return empty
        e = e.sort_values("rep")
        file = int(cell[0])
        names = e["rep"].to_numpy()
        vectors = _matrix(e["v"])
        positions = np.stack([np.frombuffer(o, dtype=kind) for o in e["order"]]).astype(np.int16)
        near = positions < posted
        out = []
        for name, v, order in zip(q["query"], q["v"], q["order"]):
            own = np.frombuffer(order, dtype=kind).astype(np.int16)
            # Who is posted in a file that this query reads before this one has been met there.
            earlier = np.flatnonzero(own < own[file])
            fresh = np.flatnonzero(~near[:, earlier].any(axis=1)) if len(earlier) else np.arange(len(names))
            if not len(fresh):
                continue
            footrule = np.abs(positions[fresh] - own).sum(axis=1, dtype=np.int32)
            most = max(LEAST_KEPT, int(np.ceil(kept * len(names))))
            if most < len(fresh):
                fresh = fresh[np.argpartition(footrule, most)[:most]]
                fresh.sort()
            score = (vectors[fresh] * np.asarray(v)).sum(axis=1)
            best = np.argsort(-score, kind="stable")[: k + 1]
            out.append(pd.DataFrame({"query": name, "rep": names[fresh[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    keys = ["file", "lb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query long, rep long, score double")
    return ranked(found, groups, asked, k, F.desc("score"))
