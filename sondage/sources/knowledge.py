"""The knowledge base: past experiments, their meta-features and results, as three tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["experiments", "features", "results"]

SCHEMAS = {
    "experiments": "experiment_id long, dataset_hash string, dataset_name string, domain string, n_instances int, "
    "n_features int, created_at timestamp, updated_at timestamp",
    "features": "experiment_id long, feature_name string, feature_value double",
    "results": "experiment_id long, algorithm_name string, f1_score double, accuracy double, precision_score double, "
    "recall_score double, cv_folds int",
}


def experiment_key(dataset_hash: str) -> Column:
    """A positive id that follows from the hash, so writers need no shared counter."""
    return F.pmod(F.xxhash64(dataset_hash), F.lit((1 << 62) - 1)) + 1


@dataclass
class KnowledgeBase:
    experiments: DataFrame
    features: DataFrame
    results: DataFrame

    # -- storage -----------------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "KnowledgeBase":
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in TABLES])

    @classmethod
    def empty(cls, spark: SparkSession) -> "KnowledgeBase":
        return cls(*[spark.createDataFrame([], SCHEMAS[t]) for t in TABLES])

    def save(self, folder: str, mode: str = "error") -> None:
        """Write to a new folder; readers of the old one are not disturbed."""
        for name in TABLES:
            getattr(self, name).write.mode(mode).parquet(f"{folder}/{name}")

    def export_csv(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.csv(f"{folder}/{name}", header=True)

    # -- reading -----------------------------------------------------------------------------

    def newest(self, n: int | None = None) -> "KnowledgeBase":
        """Experiments, newest first, with only their features and results (semi join)."""
        chosen = self.experiments.orderBy(F.col("updated_at").desc(), "experiment_id")
        if n is not None:
            chosen = chosen.limit(n)
        ids = chosen.select("experiment_id")
        return KnowledgeBase(
            chosen, self.features.join(ids, "experiment_id", "left_semi"),
            self.results.join(ids, "experiment_id", "left_semi"),
        )

    def feature_names(self) -> list[str]:
        """The names are a fixed vocabulary, far below any size that matters."""
        return sorted(r[0] for r in self.features.select("feature_name").distinct().collect())

    def wide(self, names: Sequence[str] | None = None) -> DataFrame:
        names = list(names) if names else self.feature_names()
        return self.features.groupBy("experiment_id").pivot("feature_name", names).agg(F.first("feature_value"))

    # -- writing -----------------------------------------------------------------------------

    def upsert(self, new: "KnowledgeBase") -> "KnowledgeBase":
        """Insert experiments or replace those with the same hash, features and results included.

        ``new`` tables carry ``dataset_hash``; when a hash comes more than once
        the one with the latest ``updated_at`` counts.  Features and results may
        carry ``updated_at`` too and then follow that version.
        """
        columns = [c for c in new.experiments.columns if c not in ("dataset_hash", "experiment_id", "created_at")]
        # max_by keeps one row per hash map-side, however often the hash repeats.
        latest = new.experiments.groupBy("dataset_hash").agg(
            F.max_by(F.struct(*columns), F.struct("updated_at", *columns)).alias("row"),
            F.min("created_at").alias("_first_seen"),
        ).select("dataset_hash", "row.*", "_first_seen")
        known = self.experiments.select(
            "dataset_hash", F.col("experiment_id").alias("_old_id"), F.col("created_at").alias("_old_created")
        )
        incoming = latest.join(known, "dataset_hash", "left").select(
            F.coalesce("_old_id", experiment_key("dataset_hash")).alias("experiment_id"), "dataset_hash", *columns,
            F.coalesce("_old_created", "_first_seen").alias("created_at"),
        )
        ids = incoming.select("dataset_hash", "experiment_id", "updated_at")
        replaced = ids.select("experiment_id")

        def merged(old, fresh, name):
            version = ["dataset_hash", "updated_at"] if "updated_at" in fresh.columns else ["dataset_hash"]
            # One row per (experiment, name): copies collapse before the join.
            single = fresh.drop("experiment_id").dropDuplicates([*version, name])
            rows = single.join(ids.select("experiment_id", *version), version).select(*old.columns)
            return old.join(replaced, "experiment_id", "left_anti").unionByName(rows)

        return KnowledgeBase(
            self.experiments.join(replaced, "experiment_id", "left_anti").unionByName(
                incoming.select(*self.experiments.columns)),
            merged(self.features, new.features, "feature_name"),
            merged(self.results, new.results, "algorithm_name"),
        )

    def feedback(self, observed: DataFrame) -> tuple["KnowledgeBase", DataFrame]:
        """Record observed scores ``(dataset_hash, algorithm_name, f1_score, ts)``.

        Returns the new base and the rejected rows, whose hash is unknown.  The
        latest score per (dataset, algorithm) replaces that algorithm's result
        and leaves the others alone.
        """
        latest = observed.groupBy("dataset_hash", "algorithm_name").agg(
            F.max_by("f1_score", F.struct("ts", "f1_score")).alias("f1_score"), F.max("ts").alias("ts")
        )
        known = self.experiments.select("dataset_hash", "experiment_id")
        rejects = latest.join(known, "dataset_hash", "left_anti")
        accepted = latest.join(known, "dataset_hash").select(
            "experiment_id", "algorithm_name", "f1_score", F.lit(None).cast("double").alias("accuracy"),
            F.lit(None).cast("double").alias("precision_score"), F.lit(None).cast("double").alias("recall_score"),
            F.lit(5).alias("cv_folds"),
        )
        kept = self.results.join(
            accepted.select("experiment_id", "algorithm_name"), ["experiment_id", "algorithm_name"], "left_anti"
        )
        results = kept.unionByName(accepted.select(*self.results.columns))
        return KnowledgeBase(self.experiments, self.features, results), rejects
