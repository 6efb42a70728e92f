"""Registered queries of the text operators; SQL counterparts are in ``oracle.py``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.llm.alignment import document_alignment
from weirmark.llm.common import table
from weirmark.llm.hard_negatives import hard_negatives
from weirmark.llm.language_model import language_scores
from weirmark.llm.lz_prints import edited_likeness
from weirmark.llm.mixing import mixed
from weirmark.llm.pieces import segmentation_digests
from weirmark.llm.quality_rules import quality_rules
from weirmark.llm.repeats import repeated_bytes_removed
from weirmark.llm.rule_ensemble import quality_scores
from weirmark.llm.simhash import simhash_groups
from weirmark.llm.token_counts import document_counts
from weirmark.llm.token_files import token_digests
from weirmark.llm.url_rules import url_verdicts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("n_rejections", F.size("rejected_by").cast("long")).drop("rejected_by")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_lz_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), only=["doc_id"]).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_rate", 6).alias("rate"),
        F.round("_p", 6).alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_bytes_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return document_alignment(table(spark, sf_dir, "documents"), byte_level, pieces)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_pieces": op3_pieces,
    "op4_lz_prints": op4_lz_prints,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_language_model": op6_language_model,
    "op7_url_rules": op7_url_rules,
    "op8_mixing": op8_mixing,
    "op9_repeats": op9_repeats,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}
