"""Dropping changes that others explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import CONTAINER_TYPES
from ..session import cut, parts, spread

#: Rows that are broadcast beside a snapshot.
BROADCAST_ROWS = 10_000


def own_text(entities: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(scope, id, own): an entity's text without its children's lines (those of ``entities``, or of ``children``), trimmed, blank lines dropped, joined by blanks."""
    lines = entities.select("scope", "id", "start_line", F.posexplode_outer(T.lines_of("content")).alias("at", "line"))
    child = (entities if children is None else children).filter("parent_id IS NOT NULL").select("scope", F.col("parent_id").alias("id"), F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("covered")).distinct()
    bare = lines.withColumn("covered", F.col("start_line") + F.col("at")).join(child, ["scope", "id", "covered"], "left_anti")
    joined = bare.filter("trim(line) <> ''").groupBy("scope", "id").agg(F.sort_array(F.collect_list(F.struct("at", F.trim("line").alias("line")))).alias("ls"))
    own = entities.select("scope", "id").distinct().join(joined, ["scope", "id"], "left")
    return own.select("scope", "id", F.coalesce(F.array_join(F.transform("ls", lambda s: s["line"]), " "), F.lit("")).alias("own"))


def suppress_parents(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``changes`` without containers that their changed children explain, and without children that a renamed parent explains.

    Scopes with a single change stay as they are.
    """
    keys = ["scope", "entity_id"]
    changes = cut(changes)
    many = changes.groupBy("scope").agg((F.count("*") > 1).alias("many"))
    n = parts(before, after)
    beside = lambda small: F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small
    ids = spread(changes.select("scope", F.col("entity_id").alias("child")), n, "scope", "child").distinct()
    children = before.select("scope", "parent_id", F.col("id").alias("child")).unionByName(after.select("scope", "parent_id", F.col("id").alias("child"))).filter("parent_id IS NOT NULL")
    busy = spread(children, n, "scope", "child").join(ids, ["scope", "child"], "left_semi").select("scope", F.col("parent_id").alias("entity_id"))
    containers = cut(spread(changes.filter(F.col("entity_type").isin(*CONTAINER_TYPES)), n, *keys).join(spread(busy, n, *keys), keys, "left_semi"))
    whole = containers.filter("change_type IN ('added', 'deleted')").select(*keys)
    # texts are asked for only where a container was modified
    modified = cut(containers.filter("change_type = 'modified'").select("scope", F.col("entity_id").alias("id")).distinct())

    def own(side: DataFrame, p: str) -> DataFrame:
        of = lambda c: spread(side, n, "scope", c).join(beside(modified.withColumnRenamed("id", c)), ["scope", c], "left_semi")
        found = of("id")
        return own_text(found, of("parent_id")).select("scope", F.col("id").alias("entity_id"), F.col("own").alias(p + "own")).join(found.select("scope", F.col("id").alias("entity_id"), F.col("entity_type").alias(p + "type")).distinct(), keys)

    if modified.isEmpty():
        quiet = whole.limit(0)
    else:
        quiet = containers.filter("change_type = 'modified'").join(own(before, "b_"), keys).join(own(after, "a_"), keys).filter("b_own = a_own AND b_type = a_type").select(*keys)
    left = changes.filter("change_type = 'moved' AND old_parent_id IS NOT NULL").select("scope", F.col("old_parent_id").alias("entity_id")).join(changes.select(*keys), keys, "left_semi")
    drop = whole.unionByName(quiet).unionByName(left).distinct().join(many.filter("many"), "scope", "left_semi")
    kept = cut(spread(changes, n, *keys).join(spread(drop, n, *keys), keys, "left_anti"))
    renamed = kept.filter("change_type = 'renamed' AND old_entity_name IS NOT NULL").select("scope", "entity_id", F.col("old_entity_name").alias("name"), "entity_type", "parent_id")
    renamed = cut(renamed)
    b = before.select("scope", "name", "entity_type", F.col("parent_id").alias("b_parent"), "id", "ordinal")
    named = ["scope", "name", "entity_type"]
    old = spread(b, n, *named).join(beside(renamed), named).filter(F.col("parent_id").eqNullSafe(F.col("b_parent"))).groupBy("scope", "entity_id").agg(F.min_by("id", "ordinal").alias("old_parent_id"))
    explained = old.select("scope", "old_parent_id").distinct().withColumn("explained", F.lit(True)).join(many.filter("many"), "scope", "left_semi")
    judged = kept.join(explained, ["scope", "old_parent_id"], "left")
    return judged.filter("NOT (change_type = 'moved' AND old_entity_name IS NULL AND coalesce(explained, false))").select(*changes.columns)
