import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text, lang, source) rows."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            row = (i, row, "en", "a") if row is None or isinstance(row, str) else row
            full.append((*row, None if row[1] is None else len(row[1])))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty and very long texts, repeated rows, a repeated and a null id."""
    long = " ".join(f"word{i % 977} thing{i}" for i in range(20_000))
    return make_docs(
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "de", "a"),
        (4, long, "en", "b"),
        (5, "One two three, four five.", "xx", "b"),
        (5, "One two three, four five.", "xx", "b"),
        (6, "One two three, four five.", "fr", None),
        (None, "An id that is null. ▁ é 日本語 \0", "en", "c"),
        (8, "x" * 3000, "es", "c"),
        (9, "a b\na b\n" * 300, "es", "c"),
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf_labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd documents with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "w l g s p row n_words stratum kept n_bytes ids scores others decoded fingerprint component_id _row _p _rate _kept start word key"
    return odd_docs.withColumns({name: F.lit("clash") for name in names.split()})
