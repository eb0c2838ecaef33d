"""The knowledge base on disk in versions that share what did not change.

Every table is dealt to buckets by the hash of the dataset's hash; features and results follow their
experiment.  A version is a manifest, a small table that names for each table and bucket
the version whose files hold it.  A change loads the buckets its datasets fall into, writes those anew and
publishes a manifest that points to them and, for the rest, to what is there already.  Readers
keep the version they began with.  Writing a version again, after a failure, replaces it.

Features and results without an experiment stay in the first bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.plans.durable import materialise
from sondage.sources.knowledge import SCHEMAS, TABLES, KnowledgeBase

BUCKETS = 64
_MANIFEST = "`table` string, bucket int, version long"


class KnowledgeStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- versions ----------------------------------------------------------------------------

    def _paths(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [(system, s.getPath()) for s in system.globStatus(path) or []]

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(int(p.getParent().getName()[2:]) for _, p in self._paths("manifest/v=*/_SUCCESS"))

    def _manifest(self, version: int) -> dict[tuple[str, int], int]:
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/v={version}").collect()
        return {(r["table"], r["bucket"]): r["version"] for r in rows}

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> KnowledgeBase:
        found = []
        for table in TABLES:
            paths = [f"{self.root}/data/{table}/v={v}/bucket={b}" for (t, b), v in sorted(manifest.items())
                     if t == table and (buckets is None or b in buckets)]
            found.append(self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table]))
        return KnowledgeBase(*found)

    def load(self, version: int | None = None) -> KnowledgeBase:
        """A version, the newest if not named; an empty base if there is none."""
        known = self.versions()
        if version is None and not known:
            return KnowledgeBase.empty(self.spark)
        return self._read(self._manifest(known[-1] if version is None else version))

    # -- writing -----------------------------------------------------------------------------

    def _bucket(self, column: str = "dataset_hash"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, kb: KnowledgeBase, version: int, manifest: dict) -> None:
        homes = kb.experiments.select("experiment_id", self._bucket().alias("bucket"))
        for table in TABLES:
            rows = getattr(kb, table)
            if table == "experiments":
                rows = rows.withColumn("bucket", self._bucket())
            else:
                rows = rows.join(homes, "experiment_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit(0)))
            names = [f.split(" ")[0] for f in SCHEMAS[table].split(", ")]
            rows = materialise(rows.select(*names, "bucket"), "store")
            # At most as many numbers as buckets.
            held = [r[0] for r in rows.select("bucket").distinct().collect()]
            rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/{table}/v={version}")
            manifest.update({(table, b): version for b in held})
        rows = [(t, b, v) for (t, b), v in sorted(manifest.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={version}")

    def save(self, kb: KnowledgeBase, version: int = 0) -> None:
        """The whole base as a version of its own."""
        self._write(kb, version, {})

    def apply(
        self, hashes: DataFrame, change: Callable[[KnowledgeBase], KnowledgeBase], base: int | None = None, version: int | None = None,
    ) -> int:
        """A new version with ``change`` made to the buckets of ``hashes (dataset_hash)``; returns its number.

        ``base`` is the newest version and ``version`` the next number unless given.
        """
        known = self.versions()
        base = base if base is not None else (known[-1] if known else None)
        version = version if version is not None else (-1 if base is None else base) + 1
        touched = {r[0] for r in hashes.select(self._bucket().alias("b")).distinct().collect()}
        manifest = self._manifest(base) if base is not None else {}
        changed = change(self._read(manifest, touched))
        self._write(changed, version, {k: v for k, v in manifest.items() if k[1] not in touched})
        return version

    def upsert(self, new: KnowledgeBase) -> int:
        return self.apply(new.experiments.select("dataset_hash"), lambda kb: kb.upsert(new))

    def feedback(self, observed: DataFrame, base: int | None = None, version: int | None = None) -> DataFrame:
        """Record scores as ``KnowledgeBase.feedback`` does; returns the rejected rows."""
        rejected = []

        def change(kb):
            updated, lost = kb.feedback(observed)
            rejected.append(materialise(lost, "rejects"))
            return updated

        self.apply(observed.select("dataset_hash"), change, base, version)
        return rejected[0]

    def vacuum(self, keep: int) -> int:
        """Delete the files that none of the newest ``keep`` versions points to, and older manifests; returns how many folders went."""
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        used = {(t, v, b) for n in kept for (t, b), v in self._manifest(n).items()}
        gone = 0
        for system, path in self._paths("data/*/v=*/bucket=*"):
            v, b = int(path.getParent().getName()[2:]), int(path.getName()[7:])
            # Files newer than the newest manifest belong to a version that is being written.
            if v <= versions[-1] and (path.getParent().getParent().getName(), v, b) not in used:
                gone += system.delete(path, True)
        for system, path in self._paths("manifest/v=*"):
            if int(path.getName()[2:]) in old:
                gone += system.delete(path, True)
        return gone
