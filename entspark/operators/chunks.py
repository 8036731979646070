"""Entities of texts without a grammar: runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_LINES = 20


def chunk_text(files: DataFrame, key: str, lines: int = CHUNK_LINES) -> DataFrame:
    """(key, name, content, start_line, end_line) of every ``lines`` lines of (key, content).

    The lines are cut in the row that has them; no row is sent anywhere.
    """
    every = T.lines_of("content")
    cut = F.transform(
        F.when(F.size(every) > 0, F.sequence(F.lit(0), F.size(every) - 1, F.lit(lines))).otherwise(F.array().cast("array<int>")),
        lambda a: F.struct((a + 1).alias("start_line"), F.least(a + lines, F.size(every)).alias("end_line"), F.array_join(F.slice(every, a + 1, F.lit(lines)), "\n").alias("content")),
    )
    return files.filter("content IS NOT NULL").select(key, F.inline(cut)).select(key, F.concat(F.lit("lines "), "start_line", F.lit("-"), "end_line").alias("name"), "content", "start_line", "end_line")
