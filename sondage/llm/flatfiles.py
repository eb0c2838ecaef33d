"""Flat binary files on any file system: written by Spark's own writer, read by ranges.

Records go through the text writer, whose committer keeps files whole when
executors are lost; the bytes between two records are its line separator.  Readers open a
path by its URI and read only their range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.words import Hasher, word_hashes

#: Words are numbered from 1 by hash; 0 is left for the end of a document and for padding.
IDS = 65535


def word_ids(df: DataFrame, text: Column, columns: dict[str, Column]) -> DataFrame:
    """``columns`` and ``tokens``: the 16-bit ids of each text's words as little-endian bytes."""
    names = list(columns)
    some = df.select(*[c.alias(n) for n, c in columns.items()], text.alias("text"))

    def run(batches):
        hasher = Hasher(5)
        for batch in batches:
            words, offsets = word_hashes(batch.column(len(names)), hasher)
            flat = (words % np.uint64(IDS) + np.uint64(1)).astype("<u2")
            tokens = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(tokens, pa.binary())], [*names, "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields[:-1])
    return some.mapInArrow(run, f"{kinds}, tokens binary")


def write(df: DataFrame, record: str, path: str, separator: str, by: tuple[str, ...] = ()) -> None:
    """The ``record`` bytes of each row, in the order of the partitions, each followed by ``separator``."""
    rows = df.select(F.col(record).cast("string").alias("value"), *by)
    rows.write.option("lineSep", separator).partitionBy(*by).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the data files below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
    return found.load(path).select("path", "length")


def read_range(path: str, start: int, length: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        return file.read_at(length, start)
