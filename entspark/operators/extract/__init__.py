"""From files to entities: one pass over a table of files, each read by the extractor of its kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...model import ENTITY
from .base import Entity
from .registry import Registry, custom_mappings, detect

__all__ = ["Entity", "Registry", "custom_mappings", "detect", "extract_entities", "extract_files"]

_NAMES = ("scope", "id", "file_path", "entity_type", "name", "parent_id", "content", "content_hash", "structural_hash", "start_line", "end_line", "ordinal", "metadata")
_TYPES = (*(pa.string(),) * 9, *(pa.int32(),) * 3, pa.map_(pa.string(), pa.string()))


def extract_entities(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Entities with a scope, of files (scope, path, plugin_path, hint, content); files with a null text have none."""
    registry = registry or Registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scope, path, plugin_path, hint, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None:
                    rows += [e.row(scope, path, k) for k, e in enumerate(registry.extract(text, path, plugin_path, hint))]
            if rows:
                arrays = [pa.array([r[k] for r in rows] if k < 12 else [None if r[k] is None else list(r[k].items()) for r in rows], t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(_NAMES))

    return files.select("scope", "path", "plugin_path", "hint", "content").mapInArrow(run, f"scope string, {ENTITY}")


def extract_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Entities of a snapshot (path, content); each file is its own scope."""
    return extract_entities(files.select(F.col("path").alias("scope"), "path", F.col("path").alias("plugin_path"), F.col("content").alias("hint"), "content"), registry)
