"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import audit, chat, decontaminate, infill, langid, media, packing, passages, secrets, simhash, suffixes, tokens, warc
from .shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark that leak into documents, a row for each pair; null and empty texts and items leak nothing."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, with checksums of their ids; null and empty texts make one piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; texts without words have fingerprint zero and share a component."""
    fps = materialize(spark, simhash.fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "fingerprints")
    found = simhash.near_duplicates(fps, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; und for texts without letters."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a revisit that has no response raises."""
    records = warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.checked(materialize(spark, records, "records"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and completions of conversations 2k (chosen) and 2k + 1 (rejected), by turns."""
    turns = table(spark, sf_dir, "conversations")
    return chat.preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage of 51 words or more, with their class and passages; others have no row."""
    found = passages.near_duplicate_passages(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "class_id", listed.alias("passages"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secrets of every document; empty lists for texts without any."""
    found = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an AVI file and decoded again: digests, shots and clips."""
    found = media.media_features(media.encode_media(table(spark, sf_dir, "documents")))
    return found.withColumn("clips", F.array_join(F.transform("clips", lambda c: F.format_string("%.3f-%.3f", c["start_s"], c["end_s"])), ","))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, step by step and source by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, by seeds of its id, with checksums of the output and of the text rebuilt from it."""
    out = infill.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 400-byte strings standing elsewhere too cover."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries():
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_language_id": op4_language_id,
        "op5_warc": op5_warc,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_secret_scans": op8_secret_scans,
        "op9_media_columns": op9_media_columns,
        "op10_token_counts": op10_token_counts,
        "op11_filter_audit": op11_filter_audit,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_suffix_array_dedup": op13_suffix_array_dedup,
    }


def oracle_sql():
    return {
        "op5_warc": OP5_SQL,
        "op6_chat_formatting": chat.SQL,
        "op11_filter_audit": audit.SQL,
        "op12_fill_in_middle": infill.SQL,
    }
