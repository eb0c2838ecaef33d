"""Training-order materialisation: sequences in a keyed random order, in files for sequential reads.

Texts become word ids, cut into sequences of fixed length.  Sequences are
numbered in the order of document and place; a keyed Feistel permutation
gives every number a global slot, walking its cycle until the slot is below the
number of sequences.  No random state is kept: the key and the count decide.  Shard s holds the
slots from s * per_shard on, in order, as records of fixed stride, so a reader finds any
slot by arithmetic and can go on from where it stopped.

A record is the id (8 bytes, the largest long for null), the sequence's
place in its document (4), its number of tokens (4), the tokens (2 each, padded with 0)
and two newlines; integers are little-endian.

Defined results: null and empty texts have no sequence; documents of the same id
follow each other by a hash of their text, and copies among those in any order.  An empty table gives an
empty folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import flatfiles
from sondage.plans.durable import materialise
from sondage.plans.ordering import running

ROUNDS = 6
_KEY = (1 << 63) - 1
_END = "\n\n"


def round_keys(key: str) -> list[tuple[int, int]]:
    """Per round a mask and an odd factor, both below 2**31."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.sha256(f"{key}-{i}".encode()).digest()
        out.append((int.from_bytes(digest[:4], "little") >> 1, int.from_bytes(digest[4:8], "little") >> 1 | 1))
    return out


def half_bits(count: int) -> int:
    return max(1, ((count - 1).bit_length() + 1) // 2)


def slots(numbers: np.ndarray, count: int, key: str) -> np.ndarray:
    """The slots of numbers below ``count``: a permutation of them."""
    width = half_bits(count)
    if width > 31:
        raise ValueError("more than 2**62 sequences")
    mask, keys = (1 << width) - 1, round_keys(key)
    out = np.array(numbers, dtype=np.int64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> width, out[open_] & mask
        for xor, factor in keys:
            left, right = right, left ^ ((((right ^ xor) * factor) >> 15) & mask)
        out[open_] = left << width | right
        open_ = open_[out[open_] >= count]
    return out


@dataclass(frozen=True)
class Layout:
    path: str
    count: int
    length: int
    per_shard: int

    @property
    def stride(self) -> int:
        return 16 + 2 * self.length + len(_END)


def write(df: DataFrame, path: str, key: str, length: int = 256, per_shard: int = 1 << 14,
          text: str = "text", doc: str = "doc_id") -> Layout:
    """Write all sequences of ``df`` below ``path``, one folder a shard."""
    owner = F.coalesce(F.col(doc).cast("long"), F.lit(_KEY))
    # The number keeps repeated rows apart; it is written down before it is used.
    tokens = flatfiles.word_ids(df, F.col(text), {"owner": owner, "body": F.xxhash64(text), "row": F.monotonically_increasing_id()})
    tokens = materialise(tokens.where(F.octet_length("tokens") > 0), "tokens")
    sized = tokens.select("owner", "body", "row", F.expr(f"(octet_length(tokens) div 2 + {length - 1}) div {length}").alias("n"))
    numbered = materialise(running(sized, ["owner", "body", "row"], sums={"upto": "n"}), "numbered")
    count = numbered.agg(F.max("upto")).first()[0] or 0
    layout = Layout(path, count, length, per_shard)
    starts = numbered.select("row", (F.col("upto") - F.col("n")).alias("start"))
    size = 2 * length

    def cut(batches):
        for batch in batches:
            held, numbers = [], []
            for owner, body, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for place, at in enumerate(range(0, len(body), size)):
                    part = body[at : at + size]
                    head = np.array([owner], "<i8").tobytes() + np.array([place, len(part) // 2], "<i4").tobytes()
                    held.append(head + part.ljust(size, b"\0"))
                    numbers.append(start + place)
            slot = slots(np.array(numbers, dtype=np.int64), count, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard), pa.array(slot), pa.array(held, pa.binary())], ["shard", "slot", "record"])

    made = tokens.join(starts, "row").select("owner", "tokens", "start").mapInArrow(cut, "shard long, slot long, record binary")
    # A shard is a range of slots and goes to one task, which writes it in order.
    ordered = made.repartition("shard").sortWithinPartitions("shard", "slot")
    flatfiles.write(ordered, "record", path, _END, ("shard",))
    return layout


def read(spark: SparkSession, layout: Layout, start: int = 0, stop: int | None = None, rows: int = 1 << 13) -> DataFrame:
    """``(slot, shard, owner, place, n_tokens, tokens)`` of the slots from ``start`` to ``stop``, by ranges of files."""
    stop = layout.count if stop is None else min(stop, layout.count)
    schema = "slot long, shard long, owner long, place int, n_tokens int, tokens binary"
    if start >= stop:
        return spark.createDataFrame([], schema)
    found = flatfiles.files(spark, layout.path).select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard"), "path")
    per = layout.per_shard
    found = found.where((F.col("shard") >= start // per) & (F.col("shard") <= (stop - 1) // per))
    low, high = F.greatest(F.col("shard") * per, F.lit(start)), F.least((F.col("shard") + 1) * per, F.lit(stop))
    cut = found.select("shard", "path", F.explode(F.sequence(low, high - 1, F.lit(rows).cast("long"))).alias("first"), high.alias("high"))
    stride, length = layout.stride, layout.length
    record = np.dtype([("owner", "<i8"), ("place", "<i4"), ("n_tokens", "<i4"), ("tokens", f"V{2 * length}"), ("end", f"S{len(_END)}")])

    def run(batches):
        for batch in batches:
            for shard, name, first, high in batch.itertuples(index=False):
                n = min(rows, high - first)
                got = np.frombuffer(flatfiles.read_range(name, (first - shard * per) * stride, n * stride), dtype=record)
                if len(got) != n or (got["end"] != _END.encode()).any():
                    raise ValueError(f"{name} is damaged near slot {first}")
                yield pd.DataFrame({
                    "slot": np.arange(first, first + n), "shard": shard, "owner": got["owner"], "place": got["place"],
                    "n_tokens": got["n_tokens"], "tokens": [t.tobytes()[: 2 * k] for t, k in zip(got["tokens"], got["n_tokens"])]})

    return cut.repartition("shard", "first").mapInPandas(run, schema)
