"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, source mix.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns the
columns of ``documents``; the last one adds how often the mix takes each document (documents that it
does not take are gone). Secrets are masked, their documents stay.

A row is a document: null texts fail the quality rules; null or repeated doc_ids, ties, empty tables and
further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, mixing, neardup, quality, secretscan
from tallyspark.llm.common import ensure_checkpoint_dir

#: SuperMinHash groups and character models have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoff; null and empty texts fail, an empty table stays empty."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null ids and repeated rows are rows like others, texts without words all stay."""
    return neardup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; texts without words hold none, an empty benchmark removes nothing."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars recounted; null texts stay null, without labels only the fixed patterns are masked."""
    return secretscan.redact(docs, secretscan.default_model(spark, docs, _table(spark, sf_dir, "labels")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with its columns; a column of ``docs`` that has one of their names gives way."""
    own = ["size", "source_size", "target", "repeats", "taken"]
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))
    return mixing.mix(packed, keep=("_doc",)).where("repeats > 0").select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in own], *own)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
