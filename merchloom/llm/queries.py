"""The corpus operators as queries over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontamination, merkle_manifest, mixing, near_dedup, suffix_dedup
from .common import ascii_lower, remainder, table
from .html_extraction import extract_text
from .license_scan import scan_licenses
from .merkle_manifest import FIELDS, leaf_digest, verified_proofs
from .quality_rules import quality_rules
from .sharding import shuffle_into_shards
from .token_counts import token_counts
from .toxicity import fit, toxicity
from .whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    out = context_tree.tree_scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored = toxicity(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "n_hits", "n_words")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    return verified_proofs(docs, changed=F.when(remainder(F.col("doc_id"), 5) == 0, tampered))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shuffle_into_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_decontamination, op4_quality_rules, op5_context_tree, op6_near_duplicates, op7_suffix_dedup, op8_toxicity, op9_html_extraction, op10_license_scan, op11_merkle_manifest, op12_sharding, op13_whitening)}
#: op2 has none: SQL gives its first five columns (mixing.SQL, compared in a test), but neither shards nor positions.
ORACLE_SQL: dict[str, str] = {"op3_decontamination": decontamination.SQL, "op6_near_duplicates": near_dedup.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op11_merkle_manifest": merkle_manifest.SQL}
