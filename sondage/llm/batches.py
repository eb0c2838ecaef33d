"""Small Arrow batches for rows that hold whole texts, and Python workers that hold no more than they need."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows at once to Python; the session's setting comes back after."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)


def give_back() -> None:
    """Freed memory goes back to the system: workers stay between tasks, and all of an executor count towards its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # Only glibc keeps freed memory so.


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what was freed after each of them goes back, so that an idle worker keeps only what it remembers."""
    for batch in batches:
        yield batch
        del batch
        give_back()
