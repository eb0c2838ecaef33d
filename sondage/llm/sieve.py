"""A fixed-size bitmap that spares most rows a shuffle before a join.

The keys of the small side set bits by hash; rows of the large side whose bit
is not set cannot join.  The bitmap has ``BITS`` bits whatever the number of
keys, so its broadcast is bounded; many keys only make it less selective.  The
join itself must still follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

BITS = 1 << 24


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def sieve(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the first column of ``keys``."""
    return df.where(sieve_flag(df, key, keys))


def sieve_flag(df: DataFrame, key: Column, keys: DataFrame) -> Column:
    """Whether ``key`` of a row of ``df`` may be in the first column of ``keys``."""
    place = _place(F.col(keys.columns[0]))
    # At most BITS / 32768 rows of 4 KB come back.
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    held = np.zeros(BITS // 8 + 4096, dtype=np.uint8)
    for part, bits in parts:
        at = (part - 1) * 4096
        held[at + 4096 : at + 8192] = np.frombuffer(bits, dtype=np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf(BooleanType())
    def may(place: pa.Array, bucket: pa.Array, bit: pa.Array) -> pa.Array:
        at = bucket.to_numpy().astype(np.int64) * 4096 + (bit.to_numpy() >> 3)
        return pa.array((shared.value[at] >> (bit.to_numpy() & 7) & 1).astype(bool))

    place = _place(key)
    return may(place, F.bitmap_bucket_number(place), F.bitmap_bit_position(place))
