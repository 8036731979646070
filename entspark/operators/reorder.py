"""Reordered entities: those outside the longest increasing run of their places."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import match as M


def longest_increasing(seq: list[int]) -> set[int]:
    """Places of one longest strictly increasing subsequence (patience sorting; a later tail replaces an earlier)."""
    tails: list[int] = []
    at: list[int] = []
    link: list[int] = []
    for k, value in enumerate(seq):
        pile = bisect_left(tails, value)
        if pile == len(tails):
            tails.append(value)
            at.append(k)
        else:
            tails[pile], at[pile] = value, k
        link.append(at[pile - 1] if pile else -1)
    out: set[int] = set()
    k = at[-1] if at else -1
    while k >= 0:
        out.add(k)
        k = link[k]
    return out


def _outside(pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values(["b_start_line", "b_ordinal"], kind="stable")
    keep = longest_increasing(pairs["a_start_line"].tolist())
    return pairs.iloc[[k for k in range(len(pairs)) if k not in keep]][["scope", "a_id"]]


def reordered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change rows of unchanged entities whose order in their file changed."""
    before, after = M.latest_occurrence(before), M.latest_occurrence(after)
    same = M.match_by_id(before, after).filter("b_content_hash = a_content_hash AND b_file_path = a_file_path")
    moved = same.select("scope", "a_file_path", "a_id", "b_start_line", "b_ordinal", "a_start_line").groupBy("scope", "a_file_path").applyInPandas(_outside, "scope string, a_id string")
    return M.one_sided(after.join(moved.withColumnRenamed("a_id", "id"), ["scope", "id"], "left_semi"), "reordered")


def steps_back(pairs: DataFrame) -> DataFrame:
    """The necessary test in SQL: files where some entity stands before its predecessor, with how many do."""
    from pyspark.sql import Window as W

    back = (F.lag("a_start_line").over(W.partitionBy("file_path").orderBy("b_start_line", "id")) > F.col("a_start_line")).cast("int")
    return pairs.withColumn("back", F.coalesce(back, F.lit(0))).groupBy("file_path").agg(F.sum("back").alias("steps_back"))
