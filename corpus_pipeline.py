"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.

Defined cases, of every stage: an empty table gives an empty result with the stage's columns; further columns, whatever
their names, are kept by all stages but the last; rows are judged one by one where they repeat or their doc_id is null,
except that repeated texts with words are near duplicates.  Of each stage: see its own docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, jaccard, quality, secrets
from tessera.llm.frames import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels of the documents given.

    A null or empty text is one passage without content and is judged by its score like any other; a long text has all its
    passages weighed; repeated rows have equal scores.  Without labels of both kinds nothing can be learned: every score
    is the share of label 1 (no labels: 0.5).
    """
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    Texts that are null, empty or without words are in no group and all stay; of rows with one doc_id in a group, one
    stays; a null doc_id comes after all others.
    """
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs.

    Texts that are null or without words are clean; items without words have no window; an empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and counts n_chars anew where docs has it.

    A null text stays null, an empty one empty; spans that overlap share one mask; a null source or lang is one owner or
    repository of its own.
    """
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens, ids_sha256, decoded_sha256 of each document.

    A null text counts as empty: it has no ids and the hash of no bytes; repeated rows give repeated results.
    """
    return bpe.encode_and_decode(docs, keep=True)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: The quality classifier is learned and tokens follow byte-pair ranks: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
