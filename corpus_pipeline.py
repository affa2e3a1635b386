"""A corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, byte-level BPE encoding and decoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and reread as
the next stage's documents. All but the last return the columns of ``documents``. NULL texts have no language
and go with the first stage; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from shelfmark.llm.queries import codec
from shelfmark.session import stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.drop_unknown(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.drop_near_copies(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics, repeated where there are too few."""
    return mixing.sample_mix(docs, repeats=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, decoded again and compared with the bytes of the texts."""
    return byte_bpe.token_rows(docs, codec())


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("source_mixing", target_mix),
    ("byte_bpe", tokens),
]

#: Trained models and iterated weights are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
