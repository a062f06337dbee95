"""Incremental indexing: which documents are parsed again, and a snapshot store keyed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reuse_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, content_hash, state (reused, reparsed, removed) of files and known documents, both (path, content_hash)."""
    old = known.select(F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    both = files.select("path", "content_hash").join(old, F.col("path") == F.col("old_path"), "full_outer")
    state = F.when(F.col("path").isNull(), "removed").when(F.col("old_path").isNull() | ~F.col("content_hash").eqNullSafe(F.col("old_hash")), "reparsed").otherwise("reused")
    return both.select(F.coalesce("path", "old_path").alias("path"), F.coalesce("content_hash", "old_hash").alias("content_hash"), state.alias("state"))


def stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("state").agg(F.count("*").alias("n"))


class SnapshotStore:
    """Rows of parsed documents in Parquet, partitioned by content hash; a hash that isn't there is a miss."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> None:
        """rows have content_hash; equal hashes are replaced, others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content_hash").parquet(self.path)

    def hashes(self) -> DataFrame | None:
        """content_hash of what is stored; None before anything is."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.parquet(self.path).select("content_hash").distinct()

    def get(self, hashes: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.path).join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")

    def stale(self, live: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.path).select("content_hash").distinct().join(live.select("content_hash").distinct(), "content_hash", "left_anti")

    def prune(self, live: DataFrame) -> int:
        """Removes the partitions of hashes that no live document has; their number is bounded by the stored documents."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        gone = [r.content_hash for r in self.stale(live).toLocalIterator()]
        for h in gone:
            p = hadoop(f"{self.path}/content_hash={h}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return len(gone)


def fingerprint(config: dict) -> str:
    """What a stored document depends on besides its bytes; another fingerprint means nothing is reused."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
