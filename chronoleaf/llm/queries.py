"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoleaf.llm import gam, html_tree, media, minhash, mixing, oracles, packing, quality_rules, repair, secrets, sharding, simple8b, suffix_dedup, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_table(table(spark, sf_dir, "documents"))


def secret_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's operator on a ledger that is not new: after the even documents, all by a newer rule version."""
    return secrets.rescan(table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_table(table(spark, sf_dir, "documents")))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUALITY = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*QUALITY)


def quality_rules_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator with one joint chain per stratum."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_rules.joint_thresholds).select(*QUALITY)


def quality_rules_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator with one joint chain per stratum and a scale per rule, as the pipeline uses it."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_rules.scaled_thresholds).select(*QUALITY)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.read_token_files(spark, simple8b.write_token_files(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_media_columns, op3_quality_gam, op4_quality_rules, op5_token_files, op6_suffix_dedup, op7_source_mixing, op8_packing, op9_near_duplicates, op10_main_text, op11_sharding, op12_whitening, op13_conversation_repair, quality_rules_joint, quality_rules_scaled, secret_rescan)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
