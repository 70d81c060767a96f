"""Stages from raw documents to token ids, each one of the operators of `escarp.llm`.

Every stage works on all that the one before kept: toxic documents go, of equal texts one stays,
of each group of near-duplicates one stays, the mix takes words of the sources by weight, and what
is left is encoded. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from escarp.llm import exact_dedup, mixing, queries, simhash, toxicity
from escarp.session import materialize, scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return toxicity.accepted(docs, queries.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints (three-word shingles) are linked at 2 bits that of the smallest id."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes: a row per document and pass over its source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left: their number, digests of ids and decoded bytes."""
    return queries.encoded_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL says a trained classifier or a merge list; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    scratch = scratch_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{scratch}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
