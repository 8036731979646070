"""From raw documents to a training mixture, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes what it
returns as Parquet in the shared folder and reads that again as the next
stage's documents; a stage's folder goes once the next one is written.  All but
the last return the columns of ``documents``.

Defined results, of all stages: further columns, whatever their names, stay as
they are; empty tables give empty results; texts of any length are read whole.
Documents with a null or blank text go at the first stage, the others at none
for their nulls: a null doc_id has no copies, a null source or language is a
value of its own.  Repeated rows with one doc_id and text leave one at the
second stage; of a class of near copies the least doc_id stays, so ties don't
arise.  A document that is nothing but benchmark goes at the third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from entspark.llm import decontaminate, kernels, mixing, ngram_join, quality, secret_scan


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.keep_good(kernels.small_batches(docs), kernels.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return ngram_join.deduplicate(kernels.small_batches(docs)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(kernels.small_batches(docs), kernels.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by the name of its rule."""
    return secret_scan.redact(docs, secret_scan.ledger_of(spark, sf_dir))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global pseudo-random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mix_sources", mixing_stage),
]

#: The first stage is a trained classifier, which SQL can't express; tests compare the rest with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mixture of the ``documents`` of a folder."""
    folder = f"{kernels.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = kernels.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            kernels.remove(spark, before)
        before = path
    return docs
