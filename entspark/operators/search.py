"""Finding entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose name or id has the text, in any case."""
    q = F.lit(query.lower())
    return entities.filter(F.contains(F.lower("name"), q) | F.contains(F.lower("id"), q))


def find(entities: DataFrame, name: str | None = None, entity_id: str | None = None, file_path: str | None = None) -> DataFrame:
    """One entity: of an id, or the first of a name by (file, line); a file hint excludes others."""
    if entity_id is not None:
        return entities.filter(F.col("id") == entity_id).limit(1)
    found = entities.filter(F.col("name") == name)
    if file_path is not None:
        found = found.filter(F.col("file_path") == file_path)
    return found.orderBy("file_path", "start_line", "id").limit(1)


def find_near(entities: DataFrame, name: str, file_path: str) -> DataFrame:
    """One entity of a name, rather in the given file than in another."""
    return entities.filter(F.col("name") == name).orderBy(F.when(F.col("file_path") == file_path, 0).otherwise(1), "file_path", "start_line", "id").limit(1)
