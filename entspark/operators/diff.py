"""The whole diff: match, find reorders, suppress, add orphans, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CHANGE_TYPES
from ..session import cut
from . import match as M
from .orphans import orphan_changes
from .reorder import reordered
from .suppress import suppress_parents


def diff_entities(before: DataFrame, after: DataFrame, similarity: float | None = M.SIMILARITY, reorders: bool = True) -> DataFrame:
    """Changes between two snapshots of entities with a ``scope``."""
    before, after = cut(before), cut(after)
    changes = M.match_entities(before, after, similarity)
    if reorders:
        changes = changes.unionByName(reordered(before, after))
    return M.with_parent_names(suppress_parents(cut(changes), before, after), before, after)


def diff_files(files: DataFrame, registry=None) -> DataFrame:
    """Changes of a table of file changes (old and new texts), entities and uncovered lines."""
    from .extract import extract_entities

    files = files.withColumn("before_content", F.when(F.col("status") != "added", F.col("before_content"))).withColumn("after_content", F.when(F.col("status") != "deleted", F.col("after_content")))
    hint = F.coalesce("after_content", "before_content")
    old_path = F.coalesce("old_file_path", "file_path")
    before = cut(extract_entities(files.filter("before_content IS NOT NULL").select(F.col("file_path").alias("scope"), old_path.alias("path"), F.col("file_path").alias("plugin_path"), hint.alias("hint"), F.col("before_content").alias("content")), registry))
    after = cut(extract_entities(files.filter("after_content IS NOT NULL").select(F.col("file_path").alias("scope"), F.col("file_path").alias("path"), F.col("file_path").alias("plugin_path"), hint.alias("hint"), F.col("after_content").alias("content")), registry))
    orphans = orphan_changes(files, before, after).withColumn("parent_name", F.lit(None).cast("string"))
    return diff_entities(before, after).unionByName(orphans, allowMissingColumns=True)


def summary(changes: DataFrame) -> DataFrame:
    """One row: files with a change, changes by kind (orphans apart), orphans and the total of all."""
    entity = F.col("entity_type") != "orphan"
    return changes.agg(
        F.count_distinct("file_path").alias("file_count"),
        *(F.count_if(entity & (F.col("change_type") == k)).alias(k) for k in CHANGE_TYPES),
        F.count_if(~entity).alias("orphan"),
        F.count("*").alias("total"),
    )


def by_file(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file_path", "change_type").agg(F.count("*").alias("n"))


def rollup_counts(changes: DataFrame) -> DataFrame:
    """Counts by file, type and kind with all subtotals (an extension)."""
    return changes.rollup("file_path", "entity_type", "change_type").agg(F.count("*").alias("n"))


def histogram(changes: DataFrame, *columns: str) -> DataFrame:
    return changes.groupBy(*columns).agg(F.count("*").alias("n"))
