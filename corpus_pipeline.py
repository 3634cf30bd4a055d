"""The corpus pipeline: stages over the documents table, each a training-data operator whose decisions take effect.

Every stage takes all rows that its predecessor kept. All but the last return the columns of documents:
language ID takes out rows whose language is not told; near-duplicates and documents with benchmark items are taken out; secrets are
replaced; the last stage gives the token ids, and what they decode to as a digest.

Results: rows with a null or empty text go in the first stage, as no language is told of them; very long texts pass all stages whole; of repeated rows one stays, whatever their
ids; ties between ids go to the smallest; columns beside those that a stage reads stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import bpe, langid, secret_scan, simhash, templates
from edgeloom.llm.common import crc_mod, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are `und`, or told with too low a score, go. The model learns from the rows whose crc32 of the id modulo 3 is not 1."""
    return langid.keep_known(docs, langid.fit(docs, crc_mod(docs["doc_id"], 3) != 1))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: that of the smallest id."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, re-parameterised or not, go."""
    return templates.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars is counted anew."""
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the text that the ids decode to)."""
    return bpe.round_trip(docs).selectExpr("doc_id", "cast(size(ids) as bigint) as n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]
#: SQL has neither XXH64 nor a tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else stored(docs), sf_dir)
    return docs
