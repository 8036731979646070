"""Manifests and incremental refresh of stored entities and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def staleness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, state) of files that differ between two manifests (file_path, mtime): new, changed or removed."""
    s, c = stored.select("file_path", F.col("mtime").alias("s")), current.select("file_path", F.col("mtime").alias("c"))
    state = F.when(F.col("s").isNull(), "new").when(F.col("c").isNull(), "removed").otherwise("changed")
    return s.join(c, "file_path", "full_outer").filter("NOT (s <=> c)").select("file_path", state.alias("state"))


def split_entities(stored: DataFrame, fresh: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids of stale files' entities: changed or new, still of the same content, deleted."""
    old = stored.join(stale, "file_path", "left_semi").select("id", F.col("content_hash").alias("old"))
    both = old.join(fresh.select("id", "content_hash"), "id", "full_outer")
    return both.filter("content_hash IS NOT NULL AND NOT (old <=> content_hash)").select("id"), both.filter("old = content_hash").select("id"), both.filter("content_hash IS NULL").select("id")


def refresh(entities: DataFrame, edges: DataFrame, fresh: DataFrame, stale: DataFrame, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after the stale files were read again (``fresh`` has their entities).

    ``resolve(ids, entities)`` gives the edges of the entities named.  Entities
    of clean files that referred to something changed or deleted are resolved
    again; so are names of clean entities that a new entity may now answer,
    which keeps the result equal to a full build.
    """
    changed, clean, deleted = (cut(x) for x in split_entities(entities, fresh, stale))
    now = cut(entities.join(stale, "file_path", "left_anti").unionByName(fresh))
    touched = changed.unionByName(deleted).withColumnRenamed("id", "dst")
    affected = edges.join(touched, "dst", "left_semi").select(F.col("src").alias("id"))
    # a new name can be met by any entity of its file
    neighbours = now.join(now.join(changed, "id", "left_semi").select("file_path").distinct(), "file_path", "left_semi").select("id")
    again = cut(changed.unionByName(affected).unionByName(neighbours).distinct().join(deleted, "id", "left_anti"))
    gone = again.unionByName(deleted).withColumnRenamed("id", "src")
    kept = edges.join(gone, "src", "left_anti").join(deleted.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "ref_type")
    return now, kept.unionByName(resolve(again, now)).distinct()


def save(frame: DataFrame, path: str, partition: str = "file_bucket", buckets: int = 64) -> None:
    """Writes by buckets of the file's hash; only buckets that ``frame`` has are replaced."""
    bucketed = frame.withColumn(partition, F.pmod(F.xxhash64("file_path"), F.lit(buckets)))
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("file_bucket")


def keep(path: str, manifest: DataFrame, entities: DataFrame, edges: DataFrame) -> None:
    """Writes a snapshot under ``path``: a new version each time, which counts once its manifest, the last, is there."""
    spark = entities.sparkSession
    version = f"{path}/{max(_versions(spark, path), default=0) + 1:08d}"
    entities.write.parquet(f"{version}/entities")
    edges.write.parquet(f"{version}/edges")
    manifest.write.parquet(f"{version}/manifest")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The snapshots that are whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(p.getName()) for p in there if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "manifest/_SUCCESS"))]


def cached(spark: SparkSession, path: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(manifest, entities, edges) of the latest snapshot, of all files or of ``files`` (file_path) and the edges that leave them; None without one."""
    versions = _versions(spark, path)
    if not versions:
        return None
    manifest, entities, edges = (spark.read.parquet(f"{path}/{max(versions):08d}/{x}") for x in ("manifest", "entities", "edges"))
    if files is not None:
        manifest, entities = manifest.join(files, "file_path", "left_semi"), entities.join(files, "file_path", "left_semi")
        edges = edges.join(entities.select(F.col("id").alias("src")), "src", "left_semi")
    return manifest, entities, edges
