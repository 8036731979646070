"""Changes in lines that no entity covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def orphan_text(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(scope, orphan): the lines of (scope, content) outside all (scope, start_line, end_line), joined by LF.

    A range join as an equi-join: spans are exploded to the lines they cover.
    """
    covered = spans.filter("end_line >= start_line").select("scope", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    lines = files.select("scope", F.posexplode(T.lines_of("content")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    free = lines.join(covered, ["scope", "line"], "left_anti").groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ls"))
    return free.select("scope", F.array_join(F.transform("ls", lambda s: s["text"]), "\n").alias("orphan"))


def orphan_changes(files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One change row for each file (file_path = scope, before_content, after_content) whose uncovered text changed."""
    scoped = files.withColumn("scope", F.col("file_path"))
    b = orphan_text(scoped.select("scope", F.col("before_content").alias("content")), before).withColumnRenamed("orphan", "b")
    a = orphan_text(scoped.select("scope", F.col("after_content").alias("content")), after).withColumnRenamed("orphan", "a")
    both = scoped.select("scope", "file_path").join(b, "scope", "left").join(a, "scope", "left").na.fill("", ["a", "b"]).filter("a <> b")
    kind = F.when(F.trim("b") == "", "added").when(F.trim("a") == "", "deleted").otherwise("modified")
    none = F.lit(None).cast("string")
    name = F.concat("file_path", F.lit("::orphan"))
    return both.select(
        "scope", name.alias("id"), name.alias("entity_id"), kind.alias("change_type"), F.lit("orphan").alias("entity_type"), F.lit("module-level").alias("entity_name"), F.lit(0).alias("entity_line"), none.alias("parent_id"), "file_path",
        none.alias("old_entity_name"), none.alias("old_file_path"), none.alias("old_parent_id"), F.nullif("b", F.lit("")).alias("before_content"), F.nullif("a", F.lit("")).alias("after_content"), F.lit(True).alias("structural_change"),
    )
