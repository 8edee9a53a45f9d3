import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, docs_schema):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away home.", "en", "a", 63),
        (2, "the quick  brown fox JUMPS over the lazy dog and runs away home.", "en", "b", 63),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (4, "", "en", "a", 0),
        (5, "word " * 20_000, "en", "a", 100_000),
        (None, "no id here", "en", None, 10),
        (7, "one", "en", "c", 3),
        (8, "Écoutez: naïve café, ÀÉ <|endoftext|> don't 3.14!", "fr", "c", 45),
        (9, "release under the MIT License. under the mit license CC BY-NC", "en", "a", 60),
    ]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def sample_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
