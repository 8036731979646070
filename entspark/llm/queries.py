"""Queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, language_id, license_scan, mixing, neighbours, ngram_join, pii, quality, secret_scan

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_ngram_jaccard_join": (ngram_join.query, ngram_join.ORACLE),
    "op2_format_chats": (chat_format.query, chat_format.ORACLE),
    "op3_scan_licenses": (license_scan.query, license_scan.ORACLE),
    "op4_benchmark_decontamination": (decontaminate.query, decontaminate.ORACLE),
    "op5_find_pii": (pii.query, None),
    "op6_nearest_neighbours": (neighbours.query, None),
    "op7_identify_language": (language_id.query, None),
    "op8_secret_scan": (secret_scan.query, secret_scan.ORACLE),
    "op9_mix_sources": (mixing.query, mixing.ORACLE),
    "op10_quality_classifier": (quality.query, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
