"""A training-data pipeline over `documents`, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, near_copies, secret_scan, simhash, toxicity
from tessera.llm.common import materialize, spread, table
from tessera.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below the threshold."""
    return toxicity.reject(spread(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word
    shingles reach a similarity of 0.8."""
    docs = spread(docs)
    return simhash.one_of_each(docs, near_copies.groups(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: cut from texts that hold windows of
    a single item, and texts that hold windows of several items are dropped."""
    return decontaminate.clean(spread(docs), table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets and linked credential parts replaced by a mark."""
    return secret_scan.redact(spread(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(spread(docs), vocabulary_path(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", redacted),
    ("bpe_encoding", encoded),
]

#: SQL can express neither the neighbours' votes nor the fingerprints; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the table that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
