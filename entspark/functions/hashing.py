"""Hashes of entity texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip_comments_and_strings


def content_hash(text: Column | str, algorithm: str = "md5") -> Column:
    """``md5`` and ``xxh64`` run in the JVM; ``xxh3`` (XXH3-64, seed 0, hexadecimal) is an Arrow UDF."""
    text = F.col(text) if isinstance(text, str) else text
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "xxh64":
        return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    if algorithm == "xxh3":
        return _xxh3(text)
    raise ValueError(f"no hash {algorithm}")


@F.pandas_udf(StringType())
def _xxh3(texts: pd.Series) -> pd.Series:
    import xxhash

    return texts.map(lambda t: None if t is None else xxhash.xxh3_64_hexdigest(t.encode()))


def structural_proxy(text: Column | str, name: Column | str | None = None) -> Column:
    """A hash that spacing, comments and the entity's own name don't change; for texts without a syntax tree."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(strip_comments_and_strings(text), r"\s+", " ")
    if name is not None:
        name = F.col(name) if isinstance(name, str) else name
        bare = F.regexp_replace(bare, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])")), "")
    return F.md5(F.trim(bare))
