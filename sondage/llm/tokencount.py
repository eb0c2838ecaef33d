"""Token counts of the documents in flat token files that have no index.

A file is nothing but fixed-width token ids, each document followed by an
end-of-document id.  Files are cut into blocks of bytes; every block is searched for the
separator as one vector and reports the lengths between its separators and what is
left after the last.  A prefix scan over the blocks of a file carries what is left into the next
block that has a separator, and one over the files numbers the documents.

Defined results: two separators in a row enclose an empty document of 0
tokens; tokens after a file's last separator are a document too; an empty
file has none.  Files count in the order of their part numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.llm import flatfiles
from sondage.plans.durable import materialise
from sondage.plans.ordering import running

BLOCK_BYTES = 4 << 20
_KEY = (1 << 63) - 1


def write_flat(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """The word ids of all texts as flat files of 16-bit ids, separator 0, in the order of the key, null last."""
    owner = F.coalesce(F.col(key).cast("long"), F.lit(_KEY))
    tokens = flatfiles.word_ids(df, F.col(text), {"owner": owner})
    ordered = tokens.repartitionByRange("owner").sortWithinPartitions("owner")
    flatfiles.write(ordered, "tokens", path, "\0\0")


def scan(spark: SparkSession, path: str, separator: int = 0, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, block, lengths, left)`` per block of the files below ``path``."""
    found = flatfiles.files(spark, path).where("length > 0")
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    cut = found.select(number.alias("file"), "path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        for batch in batches:
            for file, name, length, block in batch[["file", "path", "length", "block"]].itertuples(index=False):
                start = block * block_bytes
                ids = np.frombuffer(flatfiles.read_range(name, start, min(block_bytes, length - start)), dtype=kind)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                left = len(ids) - (ends[-1] + 1 if len(ends) else 0)
                closed = len(ends)
                if start + block_bytes >= length and left:
                    lengths = np.append(lengths, left)
                yield pd.DataFrame({"file": [file], "block": [block], "lengths": [lengths.astype(np.int64)],
                                    "closed": [closed], "left": [left]})

    spread = cut.repartition("file", "block")
    return spread.mapInPandas(run, "file long, block long, lengths array<long>, closed long, `left` long")


def count(spark: SparkSession, path: str, separator: int = 0, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(ordinal, n_tokens)`` of all documents below ``path``, numbered from 0."""
    blocks = materialise(scan(spark, path, separator, width, block_bytes), "blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sized = blocks.withColumn("docs", F.size("lengths").cast("long"))
    summed = sized.withColumn("open", F.coalesce(F.sum("left").over(before), F.lit(0)))
    # What is left since the last block with a separator: sums before that block fall away.
    settled = F.coalesce(F.max(F.when(F.col("closed") > 0, F.col("open"))).over(before), F.lit(0))
    carried = summed.select(
        "file", "lengths", (F.col("open") - settled).alias("carry"),
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first"))
    totals = sized.groupBy("file").agg(F.sum("docs").alias("docs"))
    offsets = running(totals, ["file"], sums={"upto": "docs"}).select("file", (F.col("upto") - F.col("docs")).alias("offset"))
    rows = carried.join(offsets, "file").select(
        "carry", (F.col("first") + F.col("offset")).alias("first"), F.posexplode("lengths").alias("at", "length"))
    return rows.select(
        (F.col("first") + F.col("at")).alias("ordinal"),
        (F.col("length") + F.when(F.col("at") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
