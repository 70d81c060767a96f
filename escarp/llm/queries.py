"""The queries of the operators and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escarp.llm import (
    bitplane,
    bloom_lm,
    byte_bpe,
    cap_filters,
    exact_dedup,
    merkle,
    mixing,
    quality,
    secrets,
    simhash,
    spelling,
    substrings,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_documents(docs: DataFrame) -> DataFrame:
    """Byte-level BPE by the many-language rank file, and back."""
    import public_tokenizers

    return byte_bpe.digests(docs, _public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    return encoded_documents(read(spark, sf_dir, "documents"))


@query()
def op10_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in bit-plane files, read back."""
    return bitplane.round_trip(read(spark, sf_dir, "documents"), _public("byte_bpe_50k.json"))


@query()
def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked at 2 or fewer differing bits."""
    found = simhash.grouped(read(spark, sf_dir, "documents"), budget=2)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM d JOIN g USING (t)
    """
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact_dedup.verdicts(read(spark, sf_dir, "documents"))


@query()
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of 150% of all words takes, sources weighing 5, 2, 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = mixing.taken(mixing.mix(docs))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.report(read(spark, sf_dir, "documents"))


@query()
def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learnt from those whose remainder of 7 is not 2."""
    return bloom_lm.scored(read(spark, sf_dir, "documents"))


@query()
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, and whether it is toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, read(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "p_marked", "p_repeated", "p_toxic", "is_toxic")


@query()
def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels whose remainder of 5 is not 0."""
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings with cosine 0.95 or more."""
    return cap_filters.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, the form of each and the last form."""
    return spelling.grouped(spelling.vocabulary(read(spark, sf_dir, "documents")))


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
    q AS (SELECT doc_id, i, w[i] AS word,
        CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS passage FROM p),
    r AS (SELECT doc_id, i, word, CASE WHEN passage IS NULL THEN 0
        WHEN row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM q),
    s AS (SELECT doc_id, i, word, max(again) OVER
        (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
    k AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """
)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 20 words that also start earlier."""
    found = substrings.deduplicated(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", digest.alias("kept_sha256"))


@query(merkle.comparison_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document against the root of all; every fifth is tampered with."""
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.proofs(docs, fields, "doc_id", "source", {"text": merkle.lowered_in_every_fifth()})
    return found.withColumnRenamed("id", "doc_id")
