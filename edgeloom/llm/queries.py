"""The queries of this subpackage: thin digests over the operators, with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import bpe, fertility, langid, licenses, rule_ensemble, secret_scan, simhash, templates, toxicity, warc_zip
from edgeloom.llm.common import crc_mod, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] != "novel")
    return found.select("doc_id", *(_count(k) for k in secret_scan.KINDS[:3]), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("findings")).alias("spans"), _count("novel"))


def _count(kind: str):
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(docs["doc_id"], 3) != 1)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents flagged as toxic, with the probability of each category."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, crc_mod(labels["doc_id"], 5) != 0)
    return toxicity.predict(docs, chain).filter("toxic")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write(table(spark, sf_dir, "pages"))
    return warc_zip.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "decoded_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rule_ensemble.fit(docs, labels, crc_mod(labels["doc_id"], 5) != 0)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True))
    return rule_ensemble.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.assess(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {"op1_secrets": op1_secrets, "op2_language": op2_language, "op3_toxicity": op3_toxicity, "op4_warc": op4_warc, "op5_decontamination": op5_decontamination, "op6_bpe": op6_bpe, "op7_simhash": op7_simhash, "op8_quality": op8_quality, "op9_fertility": op9_fertility, "op10_licenses": op10_licenses}
#: The base32 of a SHA-1: every five hex digits are four characters.
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '')"
ORACLES: dict[str, str] = {
    "op4_warc": f"""
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
}
