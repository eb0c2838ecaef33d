"""Fill the knowledge base from many datasets held in one table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import metafeatures, metrics, training
from sondage.operators.profile import union_all
from sondage.plans.durable import materialise, scratch_path
from sondage.sources.knowledge import KnowledgeBase

#: Benchmarks that run side by side.
POOL = 4


def seed(
    df: DataFrame, dataset: str, key: str, features: Sequence[str], target: str, domain: str = "seeded",
    algorithms: Sequence[str] = training.BENCHMARK_5, folds: int = 5, base: KnowledgeBase | None = None,
) -> KnowledgeBase:
    """One experiment per value of ``dataset``: all twenty meta-features from passes grouped by
    dataset, then a benchmark of distributed fits per dataset, ``POOL`` of them side by side."""
    spark = df.sparkSession
    vectors = materialise(metafeatures.extract_many(df, dataset, key, features, target), "vectors")
    # A dataset costs several model fits, so their number is small by nature.
    names = [r[0] for r in vectors.select(dataset).orderBy(dataset).collect()]
    hashed = F.md5(F.concat_ws("|", F.lit(f"{','.join(features)}|{target}"), F.col(dataset).cast("string")))
    # Each dataset is a folder of its own, so no benchmark reads the others' rows.
    path = scratch_path(spark, "datasets")
    place = F.sha2(F.coalesce(F.concat(F.lit("d"), F.col(dataset).cast("string")), F.lit("n")), 256)
    df.select(key, *features, target, dataset, place.alias("_dataset")).write.partitionBy("_dataset").parquet(path)
    apart = spark.read.schema(df.select(key, *features, target, dataset, place.alias("_dataset")).schema).parquet(path)

    def benchmarked(name):
        folder = hashlib.sha256(("n" if name is None else f"d{name}").encode()).hexdigest()
        rows = apart.where(F.col("_dataset") == folder).drop("_dataset", dataset)
        predictions = training.cross_validate(rows, key, features, target, algorithms, folds)
        return predictions.withColumn("dataset", F.lit(name))

    with ThreadPool(POOL) as pool:
        parts = pool.map(benchmarked, names, chunksize=1)
    folds_table = metrics.summary(union_all(parts), ["dataset", "model", "fold"])
    results = folds_table.groupBy("dataset", F.col("model").alias("algorithm_name")).agg(
        F.avg("f1_weighted").alias("f1_score"), F.avg("accuracy").alias("accuracy"),
        F.avg("precision_weighted").alias("precision_score"), F.avg("recall_weighted").alias("recall_score"),
        F.count(F.lit(1)).cast("int").alias("cv_folds"))
    ids = vectors.select(F.col(dataset).alias("dataset"), hashed.alias("dataset_hash"))
    experiments = vectors.select(
        F.lit(0).cast("long").alias("experiment_id"), hashed.alias("dataset_hash"),
        F.col(dataset).cast("string").alias("dataset_name"), F.lit(domain).alias("domain"),
        F.col("l1_n_instances").cast("int").alias("n_instances"), F.lit(len(features)).alias("n_features"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    long = metafeatures.to_long(vectors, [dataset]).withColumnRenamed(dataset, "dataset")
    new = KnowledgeBase(experiments, long.join(ids, "dataset").drop("dataset"), results.join(ids, "dataset").drop("dataset"))
    return (base or KnowledgeBase.empty(spark)).upsert(new)
