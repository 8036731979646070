"""Files of a folder as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders that hold no sources of one's own.
IGNORED = ("node_modules", "target", "__pycache__", "venv", "vendor", "dist", "build")


def read_files(spark: SparkSession, root: str, extensions: list[str] | None = None, under: str | None = None, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, content, mtime) of the text files of a folder, paths from it on.

    Hidden and ignored folders are left out, and so are files that aren't
    UTF-8.  Only the files that remain are decoded.
    """
    # only what the folder itself has: its own name may begin with a dot
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", ""), F.concat(F.lit("^\\Q"), F.lit(base), F.lit("\\E/*")), "")
    files = raw.withColumn("path", path).filter(~F.rlike("path", F.lit(r"(^|/)\.[^/]")) & ~F.rlike("path", F.lit(r"(^|/)(" + "|".join(ignored) + r")/")))
    if extensions:
        files = files.filter(T.has_extension("path", extensions))
    if under:
        files = files.filter((F.col("path") == under) | F.startswith(F.col("path"), F.lit(under.rstrip("/") + "/")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", T.normalise_eol(text).alias("content"), F.col("modificationTime").alias("mtime")).filter("content IS NOT NULL")


def git_tracked(spark: SparkSession, files: DataFrame, repository: str) -> DataFrame:
    """Of files only those that git tracks or would: what its ignore files leave."""
    from .git import run

    paths = [(p,) for p in run(repository, "ls-files", "--cached", "--others", "--exclude-standard", "-z").split("\0") if p]
    return files.join(spark.createDataFrame(paths, "path string"), "path", "left_semi")


def compare_files(spark: SparkSession, old: str, new: str, old_name: str | None = None, new_name: str | None = None) -> DataFrame:
    """Two files as one change, without any repository."""
    a, b = (spark.read.text(p, wholetext=True) for p in (old, new))
    name, before = new_name or new, old_name or old
    return a.select(F.col("value").alias("before_content")).crossJoin(b.select(F.col("value").alias("after_content"))).select(
        F.lit(name).alias("file_path"), F.lit("modified").alias("status"), F.lit(before if before != name else None).cast("string").alias("old_file_path"), "before_content", "after_content"
    )


def custom_mapping_table(spark: SparkSession, mappings: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mappings.items()) or [], "extension string, canonical string")
