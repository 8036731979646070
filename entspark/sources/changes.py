"""File changes from JSON and from unified diffs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILE_CHANGE

_JSON = "array<struct<filePath:string,status:string,oldFilePath:string,beforeContent:string,afterContent:string>>"


def from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of file changes of texts that are arrays of them."""
    rows = texts.select(F.inline(F.from_json(column, _JSON)))
    return rows.select(F.col("filePath").alias("file_path"), F.lower("status").alias("status"), F.col("oldFilePath").alias("old_file_path"), F.col("beforeContent").alias("before_content"), F.col("afterContent").alias("after_content"))


def parse_patch(text: str) -> list[dict[str, str | None]]:
    """What a unified diff says of each file: paths, status, and the blobs before and after."""
    out: list[dict[str, str | None]] = []
    for line in text.split("\n"):
        if m := re.match(r"diff --git a/(.*) b/(.*)$", line):
            out.append({"old": m[1], "new": m[2], "status": "modified", "before": None, "after": None})
        elif out and line.startswith("new file mode"):
            out[-1]["status"] = "added"
        elif out and line.startswith("deleted file mode"):
            out[-1]["status"] = "deleted"
        elif out and (m := re.match(r"rename (from|to) (.*)$", line)):
            out[-1]["status"] = "renamed"
            out[-1]["old" if m[1] == "from" else "new"] = m[2]
        elif out and (m := re.match(r"index ([0-9a-f]+)\.\.([0-9a-f]+)", line)):
            out[-1]["before"], out[-1]["after"] = (None if set(x) == {"0"} else x for x in m.groups())
    return out


def from_patch(spark: SparkSession, text: str, repository: str) -> DataFrame:
    """File changes of a unified diff; texts by their blobs, else from the disk."""
    from . import git

    rows = []
    for f in parse_patch(text):
        status = f["status"]
        before = None if status == "added" or not f["before"] else git.blob(repository, f["before"])
        after = None if status == "deleted" else (git.blob(repository, f["after"]) if f["after"] else None) or git.working(repository, f["new"])
        rows.append((f["new"] if status != "deleted" else f["old"], status, f["old"] if status == "renamed" else None, before, after))
    return spark.createDataFrame(rows, FILE_CHANGE)
