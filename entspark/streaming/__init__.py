"""Streams: refresh of stored entities by micro-batch, and windows over event streams (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store as ST
from ..operators.extract import Registry, extract_files


def refresh_entities(changes: DataFrame, entities_path: str, checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Keeps stored entities up to date with a stream of (path, content); a null content removes the file.

    A file's entities are replaced as a whole, and the latest row of a file in a
    batch counts (``ts``, a column of ``changes``, says which).  Batch n writes
    version n + 1 from the latest version before it, so a batch that is run again
    doesn't read what it overwrites and leaves the same result.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.groupBy("path").agg(F.max_by("content", "ts").alias("content"))
        touched = files.select(F.col("path").alias("file_path"))
        fresh = extract_files(files.filter("content IS NOT NULL"), registry)
        try:
            kept = ST.load(spark, current_version(spark, entities_path, number + 1)).join(touched, "file_path", "left_anti")
            now = kept.unionByName(fresh)
        except FileNotFoundError:
            now = fresh
        now.write.mode("overwrite").parquet(f"{entities_path}/v{number + 1}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark, entities_path: str, below: int | None = None) -> str:
    """The folder of the latest version, of those below a number; FileNotFoundError without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(entities_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(path) else []
    versions = [v for v in versions if below is None or v < below]
    if not versions:
        raise FileNotFoundError(entities_path)
    return f"{entities_path}/v{versions[-1]}"


def windowed_hotspots(events: DataFrame, keys: list[str], length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Changes by tumbling or sliding window of ``ts``, late ones up to ``late`` counted."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(window, *keys).agg(F.count("*").alias("change_count"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "change_count")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of changes of each key with no longer pause than ``gap``."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("change_count"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "change_count")


def to_memory(frame: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
