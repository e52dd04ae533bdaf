import os

import pytest

DATA = os.environ.get("VOZMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture
def documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column."""
    words = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog ran off", "en", "s", 3, "x"),
        (1, "the cat sat on the mat and the dog ran off", "en", "s", 3, "x"),
        (2, "", None, None, None, None),
        (3, None, "en", "s", 1, "x"),
        (None, "le chat est sur la table et le chien court", "fr", None, 2, "x"),
        (4, words, "en", "s", 5, "x"),
        (5, " \t\n\n", "de", "s", 5, "x"),
        (6, "12 !! ##", "de", "s", 5, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string"
    return spark.createDataFrame(rows, schema)
