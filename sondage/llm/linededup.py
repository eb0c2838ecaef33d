"""Line deduplication that returns compressed keep bitmaps instead of text.

The two 64-bit hashes of all lines are range-partitioned together with the
document, so that even a line found in a third of all documents is dealt over
many tasks, and sorted by hash, document and position.  A stream over each
partition keeps the first document of every hash and reports the others'
positions.  A hash that goes on from one partition into the next is settled by
the partitions' boundary rows: one row each, joined by hash.

The positions a document loses become one zlib-compressed bit string.  Text is
touched again only to apply it.

Defined results: null text counts as empty, and an empty text has one empty
line.  A null id counts as the largest; rows with the same id are one document,
which never loses lines to itself.  Repeated rows each come back.  Other
columns of the input, whatever their names, are kept as they are.  A text longer than a
block is hashed block by block, cut at line breaks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from sondage.llm.batches import small_batches, tidy
from sondage.llm.words import Hasher, line_keys
from sondage.plans.durable import materialise

MIN_CHARS = 10
_LAST = (1 << 63) - 1
_REPORT = "kind int, h0 long, h1 long, owner long, body long, line int"


def _identity(text: str, key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("owner"), F.xxhash64(F.col(text)).alias("body")


def lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h0, h1, owner, body, line)`` of every line whose key has ``min_chars`` code points at least."""

    def keys(batches):
        hashers = [Hasher(11), Hasher(12)]
        for batch in tidy(batches):
            found = line_keys(batch.column(2), hashers)
            take = np.flatnonzero(found["chars"] >= min_chars)
            owner = found["text"][take]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["h0"][take].view(np.int64)), pa.array(found["h1"][take].view(np.int64)),
                    batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)),
                    pa.array(found["line"][take].astype(np.int32)),
                ],
                ["h0", "h1", "owner", "body", "line"],
            )

    return df.select(*_identity(text, key), F.col(text).alias("text")).mapInArrow(
        keys, "h0 long, h1 long, owner long, body long, line int"
    )


def _report(batches):
    """Kind 0: a lost line.  1: a line of the first hash's first owner, undecided.  2: the last hash and its first owner."""
    last, opening = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h0, h1, owner = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(h0), dtype=bool)
        new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        if last is not None:
            new[0] = (h0[0], h1[0]) != last[:2]
        else:
            opening = (h0[0], h1[0])
        group = np.cumsum(new) - 1
        firsts = owner[new]
        if not new[0]:
            group, firsts = group + 1, np.concatenate(([last[2]], firsts))
        first = firsts[group]
        last = (h0[-1], h1[-1], first[-1])
        lost = owner != first
        undecided = ~lost & (h0 == opening[0]) & (h1 == opening[1])
        take = np.flatnonzero(lost | undecided)
        yield pa.RecordBatch.from_arrays(
            [pa.array(undecided[take].astype(np.int32)), *[batch.column(i).take(pa.array(take)) for i in range(5)]],
            ["kind", "h0", "h1", "owner", "body", "line"],
        )
    if last is not None:
        yield pa.RecordBatch.from_pylist(
            [{"kind": 2, "h0": int(last[0]), "h1": int(last[1]), "owner": int(last[2]), "body": 0, "line": 0}],
            schema=pa.schema([("kind", pa.int32()), ("h0", pa.int64()), ("h1", pa.int64()), ("owner", pa.int64()),
                              ("body", pa.int64()), ("line", pa.int32())]),
        )


def keep_bitmaps(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(owner, body, n_dropped, bitmap)`` of every document that loses lines.

    ``owner`` is the id (the largest long for null), ``body`` the hash of the
    text.  The bitmap has a 1 for each kept line; lines beyond its end are kept.
    """
    with small_batches(df.sparkSession):
        found = materialise(lines(df, text, key, min_chars), "lines")
    ranged = found.repartitionByRange("h0", "h1", "owner").sortWithinPartitions("h0", "h1", "owner", "line")
    reported = materialise(ranged.mapInArrow(_report, _REPORT), "line-report")
    edges = reported.where("kind = 2").groupBy("h0", "h1").agg(F.min("owner").alias("first"))
    settled = reported.where("kind = 1").join(edges, ["h0", "h1"]).where("owner > first")
    lost = reported.where("kind = 0").select("owner", "body", "line").unionAll(settled.select("owner", "body", "line"))

    @F.pandas_udf("binary")
    def packed(dropped: pd.Series) -> pd.Series:
        def one(places):
            places = np.asarray(places)
            bits = np.ones((places.max() // 8 + 1) * 8, dtype=np.uint8)
            bits[places] = 0
            return zlib.compress(np.packbits(bits).tobytes())

        return dropped.map(one)

    # A line of a repeated row is reported once a row; the set has it once.
    grouped = lost.groupBy("owner", "body").agg(F.collect_set("line").alias("dropped"))
    return grouped.select("owner", "body", F.size("dropped").cast("long").alias("n_dropped"), packed("dropped").alias("bitmap"))


@F.arrow_udf(ArrayType(BooleanType()))
def _flags(bitmap: pa.Array) -> pa.Array:
    """The flags of a bitmap, one per line, true for a kept one."""
    out = []
    for packed in bitmap:
        bits = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint8) if packed.is_valid else np.zeros(0, dtype=np.uint8)
        out.append(np.unpackbits(bits).astype(bool) if packed.is_valid else None)
    return pa.array(out, pa.list_(pa.bool_()))


def _applied(df: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """``(row, n_dropped, kept)``: the whole input row, and its text without the lost lines where it loses any.

    Python sees the bitmaps alone; the texts stay in the JVM.
    """
    bitmaps = keep_bitmaps(df, text, key, min_chars).select("owner", "body", "n_dropped", _flags("bitmap").alias("flags"))
    owner, body = _identity(text, key)
    joined = df.select(F.struct("*").alias("row"), owner, body).join(bitmaps, ["owner", "body"], "left")
    lines = F.split(F.col(f"row.`{text}`"), "\n")
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get("flags", i), F.lit(True)))
    return joined.select("row", "n_dropped", F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).alias("kept"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """The input with two more columns: ``kept`` (the text without its lost lines) and ``n_dropped``.

    Columns of these names in the input are replaced.
    """
    found = _applied(df, text, key, min_chars)
    rest = [F.col(f"row.`{c}`") for c in df.columns if c not in ("kept", "n_dropped")]
    return found.select(
        *rest, F.coalesce("kept", F.col(f"row.`{text}`"), F.lit("")).alias("kept"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def without_repeats(
    df: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = None, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """The rows of ``df`` with their lost lines cut out of the text; where that is so, ``length``, a column, gets the new length."""
    found, changed = _applied(df, text, key, min_chars), F.col("kept").isNotNull()
    new = {text: F.col("kept")} | ({length: F.length("kept").cast(df.schema[length].dataType)} if length in df.columns else {})
    return found.select(*[
        F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in df.columns])
