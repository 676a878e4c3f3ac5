
import pytest
from pyspark.sql import functions as F

from ronda.llm.store import prepare_workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = ("id", "ids", "sig", "key", "n", "row", "begin", "bucket", "guest", "words", "sketch", "salt", "size", "score", "keep", "_row", "_id", "_text", "_key")


@pytest.fixture
def docs(spark):
    """docs((id, text), ...): documents with extra columns of clashing names."""
    prepare_workers(spark)

    def build(*rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return build


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return docs(
        (5, "Alpha beta gamma delta epsilon zeta eta theta"),
        (3, "Alpha beta gamma delta epsilon zeta eta theta"),
        (3, "Alpha beta gamma delta epsilon zeta eta theta"),
        (9, None),
        (8, ""),
        (7, " \n\t "),
        (None, "a row without an id"),
        (None, None),
        (2, "two words"),
        (1, "Été naïve \U0001f600 ΣΑΣ ½² <|endoftext|> don't"),
        (4, "long " * 30_000 + "tail"),
        (6, "z" * 60_000),
    )


