"""Ids beyond 2^53 beside null ones, and other columns, come back as they were."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirmark.llm.language_model import language_scores
from weirmark.llm.lz_prints import edited_likeness
from weirmark.llm.pieces import decoded, encoded, segmentation_digests
from weirmark.llm.repeats import repeated_bytes_removed
from weirmark.llm.token_files import read_documents, token_digests, write_token_files
from weirmark.llm.url_rules import url_verdicts

BIG = 2**53 + 1
IDS = [BIG, None, -(2**63) + 1, BIG + 2]
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    """One partition, so that all rows are one Arrow batch."""
    rows = [(i, f"text number {k} of four") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=str)


def test_ids_of_every_operator(spark, docs, tmp_path):
    want = sorted(IDS, key=str)
    assert ids(token_digests(spark, docs, WORDS, str(tmp_path / "ids"))) == want
    assert ids(segmentation_digests(docs, PIECES)) == want
    assert ids(edited_likeness(docs)) == want
    assert ids(language_scores(docs)) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://example.net/x").alias("url"))
    assert ids(url_verdicts(pages), "page_id") == want


def test_single_documents_by_large_ids(docs, tmp_path):
    files = [r["path"] for r in write_token_files(docs, WORDS, str(tmp_path / "f")).collect()]
    assert set(read_documents(files, {BIG, BIG + 2, BIG + 1})) == {BIG, BIG + 2}


def test_other_columns(docs):
    full = docs.withColumns(
        {
            "at": F.expr("timestamp '2024-01-02 03:04:05.123456'"),
            "local": F.expr("timestamp_ntz '2024-01-02 03:04:05.123456'"),
            "x": F.expr("IF(doc_id IS NULL, NULL, double('NaN'))"),
            "raw": F.expr("X'00ff'"),
            "list": F.expr("array(9007199254740993L, null)"),
            "pair": F.expr("struct(doc_id AS big, cast(null as string) AS s)"),
        }
    )
    plain = full.drop("text")
    done = encoded(full, PIECES)
    for out in (done, decoded(done.drop("decoded"), PIECES), repeated_bytes_removed(full)):
        back = out.select(plain.columns)
        assert back.schema.simpleString() == plain.schema.simpleString()
        assert back.exceptAll(plain).isEmpty() and plain.exceptAll(back).isEmpty()


def test_last_stage_keeps_ids(spark, docs):
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "doc_id AS n_chars")
    assert ids(corpus_pipeline.pieces(spark, full, "")) == ids(corpus_pipeline.near_duplicates(spark, full, "")) == sorted(IDS, key=str)
