"""Training corpus from ``documents``: stages that each work on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.llm.common import stored, table
from weirmark.llm.mixing import mixed
from weirmark.llm.pieces import encoded
from weirmark.llm.repeats import repeated_bytes_removed
from weirmark.llm.rule_ensemble import accepted
from weirmark.llm.simhash import deduplicated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: fingerprints of three-word shingles that differ in three bits at most.
SHINGLE, MAX_BITS = 3, 3
#: Share of the tokens that mixing is to keep.
BUDGET = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble rejects."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies."""
    return deduplicated(docs.select(*COLUMNS), SHINGLE, MAX_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 200 bytes or more that occur twice; no document goes."""
    cut = repeated_bytes_removed(docs.select(*COLUMNS), as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that ``BUDGET`` of the tokens stay, with the target marginals as far as cells have enough."""
    return mixed(docs.select(*COLUMNS), budget=BUDGET).where("_kept").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of the N best segmentations and the text that they decode to."""
    out = encoded(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("n_pieces", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: The quality classifier is a trained model, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
