"""Operators over versions: logs, blame, evolution, hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def log(commits: DataFrame, limit: int | None = 50) -> DataFrame:
    """Commits from the newest on."""
    out = commits.orderBy(F.desc("ts"), "sha")
    return out if limit is None else out.limit(limit)


def file_history(blobs: DataFrame) -> DataFrame:
    """(file_path, sha, ts, kind) of the commits that changed a file: its blob differs from the version before (null: absent)."""
    before = F.lag("blob").over(W.partitionBy("file_path").orderBy("ts", "sha"))
    changed = blobs.withColumn("before", before).filter("NOT (before <=> blob)")
    return changed.select("file_path", "sha", "ts", F.when(F.col("before").isNull(), "added").when(F.col("blob").isNull(), "deleted").otherwise("modified").alias("kind"))


def touched_paths(changes: DataFrame) -> DataFrame:
    """(sha, path): old and new paths of each commit's changes, once each."""
    new = changes.select("sha", F.col("file_path").alias("path"))
    return new.union(changes.select("sha", F.col("old_file_path").alias("path"))).filter("path IS NOT NULL").distinct()


def consecutive(commits: DataFrame) -> DataFrame:
    """(older, newer): each commit with the one before it."""
    order = [F.desc("ts"), F.col("sha")]
    parts = cut(commits.select("ts", "sha").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # a range of the order in each part: the places before it are counted, so no part holds all commits
    starts, at = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["count"]
    if not starts:
        return commits.select(F.col("sha").alias("older"), F.col("sha").alias("newer")).limit(0)
    start = commits.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("start")
    placed = cut(parts.join(F.broadcast(start), "part").select("sha", place.alias("place")))
    older = placed.select(F.col("sha").alias("older"), (F.col("place") - 1).alias("place"))
    return placed.withColumnRenamed("sha", "newer").join(older, "place").select("older", "newer")


def hotspots(changes: DataFrame) -> DataFrame:
    """(entity_name, entity_type, file_path, change_count) by how often each changed."""
    keys = ["entity_name", "entity_type", "file_path"]
    return changes.groupBy(*keys).agg(F.count("*").alias("change_count")).orderBy(F.desc("change_count"), *keys)


def blame(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """The latest commit of each entity's lines; the first line of equal times, lines without a positive time don't count.

    ``spans`` has (file_path, id, start_line, end_line), ``lines`` (file_path,
    line, ts, ...).  The range join is an equi-join on the lines of a span.
    """
    covered = spans.withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    rest = [c for c in lines.columns if c not in ("file_path", "line", "ts")]
    at = F.struct("line", "ts", *rest)
    found = covered.join(lines.filter("ts > timestamp'1970-01-01 00:00:00'"), ["file_path", "line"]).groupBy("file_path", "id").agg(F.min_by(at, F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), "line", *rest)).alias("at"))
    return found.select("file_path", "id", "at.*")


def evolution(versions: DataFrame, keys: list[str]) -> DataFrame:
    """What each version did to an entity: added, modified (logic or cosmetic), deleted, reappeared; unchanged versions drop out.

    ``versions`` has the keys, (ts, seq), ``content_hash`` (null: absent in that
    version) and ``structural_hash``.  Without both structural hashes a change
    is one of logic.
    """
    w = W.partitionBy(*keys).orderBy("ts", "seq")
    before, structure = F.lag("content_hash").over(w), F.lag("structural_hash").over(w)
    ever = F.coalesce(F.max(F.col("content_hash").isNotNull()).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    marked = versions.select("*", before.alias("_b"), structure.alias("_s"), ever.alias("_ever"))
    here = F.col("content_hash").isNotNull()
    kind = (
        F.when(here & ~F.col("_ever"), "added")
        .when(here & F.col("_b").isNull(), "reappeared")
        .when(~here & F.col("_b").isNotNull(), "deleted")
        .when(here & (F.col("_b") != F.col("content_hash")), F.when(F.col("_s") == F.col("structural_hash"), "modified (cosmetic)").otherwise("modified (logic)"))
    )
    return marked.withColumn("kind", kind).filter("kind IS NOT NULL").drop("_b", "_s", "_ever")


def moved_to(gone: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where an entity went that left its file: an entity of its name in a file of the same commit, else of its structure; the first by file.

    ``gone`` has (sha, name, structural_hash, file_path); ``candidates`` are the
    entities of files that the commit changed, with the sha.
    """
    c = candidates.select("sha", F.col("name").alias("c_name"), F.col("structural_hash").alias("c_structure"), F.col("file_path").alias("to_path"), F.col("id").alias("to_id"))
    met = gone.join(c, "sha").filter("to_path <> file_path AND (c_name = name OR c_structure = structural_hash)")
    rank = F.row_number().over(W.partitionBy("sha", "name", "file_path").orderBy(F.when(F.col("c_name") == F.col("name"), 0).otherwise(1), "to_path", "to_id"))
    return met.withColumn("_rn", rank).filter("_rn = 1").select("sha", "name", "file_path", "to_path", "to_id")
