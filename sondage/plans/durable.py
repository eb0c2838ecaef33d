"""Intermediate tables that survive the loss of executors.

A result that is read more than once, or whose row numbering must not change
between reads, is written as parquet below the shared folder that the cluster
names in ``spark.checkpoint.dir`` and read back.  Nothing is kept only in
executor memory or on executor disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    Only a local master may run without the setting; it then gets a fresh
    temporary folder, remembered in the session.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="sondage-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

