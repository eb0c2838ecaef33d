"""Exact nearest binary codes by incremental multi-index hashing.

A code of m bytes has m segments; an index table holds, per segment and value,
the codes that have it.  Round r looks up, for every open query and segment, the
values that differ in exactly r bits.  After it every code within m (r + 1) - 1
bits has been met, since a closer code must be within r bits in some segment; a query whose
last wanted neighbour lies within that is done, provably, and the others go on.

Equal codes are one entry.  A bucket is dealt in blocks by hash, and a block
sends back no more than the wanted number of codes per query, none beyond the last
wanted distance known so far.

Defined results: rows without id or whose code is null or not ``size`` bytes take no part; a
repeated id with the same code counts once.  Ties go to smaller ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.llm.permutations import classes, dealt, ranked
from sondage.plans.durable import materialise

#: Values of a segment that share a task, by their high bits.
_HIGH = 4


def sign_code(vector: str, size: int) -> Column:
    """The signs of ``8 * size`` components as bytes, the first in the highest bit; null for other lengths or missing components."""
    v = F.col(vector)
    bits = F.array_join(F.transform(v, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")
    parts = [F.lpad(F.conv(F.substring(bits, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(size)]
    whole = v.isNotNull() & (F.size(v) == 8 * size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(whole, F.unhex(F.concat(*parts)))


def search(df: DataFrame, queries: DataFrame, k: int, key: str, code: str, size: int = 8) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``df``; ``score`` is the number of different bits."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(code).alias("code")).where(
        F.col("id").isNotNull() & F.col("code").isNotNull() & (F.octet_length("code") == size)).distinct()
    rows = materialise(rows, "codes")
    groups = materialise(classes(rows, "code", k + 1), "distinct")
    wanted = rows.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id")
    heads = materialise(wanted.groupBy("code").agg(F.min("id").alias("query")), "heads")
    asked = wanted.join(heads, "code").select("query", F.col("id").alias("query_id"))

    def byte(at):
        return F.conv(F.hex(F.substring("code", at + 1, 1)), 16, 10).cast("int")

    segments = F.array(*[F.struct(F.lit(i).alias("segment"), byte(i).alias("value")) for i in range(size)])
    entries = materialise(groups.select("rep", "code", F.explode(segments).alias("s")).select("rep", "code", "s.*"), "entries")
    entries = entries.withColumn("high", F.shiftright("value", 8 - _HIGH))
    open_ = heads.withColumn("bound", F.lit(8 * size + 1))
    best = None
    for radius in range(9):
        shell = [mask for mask in range(256) if mask.bit_count() == radius]
        probes = (
            open_.select("query", "code", "bound", F.explode(segments).alias("s"))
            .select("query", "code", "bound", "s.segment", "s.value", F.explode(F.array(*map(F.lit, shell))).alias("mask"))
            .withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
            .withColumn("high", F.shiftright("value", 8 - _HIGH)))
        found = _probe(probes, entries, k, size)
        if best is not None:
            found = found.unionAll(best)
        order = W.partitionBy("query").orderBy("score", "rep")
        best = materialise(
            found.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r"), "best")
        reached = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("last"))
        state = open_.select("query", "code").join(reached, "query", "left")
        done = (F.coalesce("n", F.lit(0)) > k) & (F.col("last") <= size * (radius + 1) - 1)
        bound = F.when(F.col("n") > k, F.col("last")).otherwise(8 * size + 1).cast("int").alias("bound")
        open_ = materialise(state.where(~F.coalesce(done, F.lit(False))).select("query", "code", bound), "open")
        if not open_.take(1):
            break
    return ranked(best, groups, asked, k, F.asc("score"))


def _probe(probes: DataFrame, entries: DataFrame, k: int, size: int) -> DataFrame:
    cell = ["segment", "high"]
    left, right = dealt(probes, entries, cell, "query", "rep")

    def words(codes) -> np.ndarray:
        flat = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), size)
        return np.pad(flat, ((0, 0), (0, -size % 8))).copy().view(np.uint64)

    def compare(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0, np.int32)})]
        if len(q) and len(e):
            e = e.sort_values(["value", "rep"])
            values, names, codes = e["value"].to_numpy(), e["rep"].to_numpy(), words(e["code"])
            for value, mine in q.groupby("value"):
                at, to = np.searchsorted(values, [value, value + 1])
                if at == to:
                    continue
                own, bound = words(mine["code"]), mine["bound"].to_numpy()
                for i, name in enumerate(mine["query"].to_numpy()):
                    apart = np.bitwise_count(codes[at:to] ^ own[i]).sum(axis=1, dtype=np.int32)
                    near = np.flatnonzero(apart <= bound[i])
                    near = near[np.argsort(apart[near], kind="stable")[: k + 1]]
                    if len(near):
                        out.append(pd.DataFrame({"query": name, "rep": names[at + near], "score": apart[near]}))
        return pd.concat(out, ignore_index=True)

    keys = [*cell, "lb", "rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query long, rep long, score int")
