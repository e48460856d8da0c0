import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

SF001 = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [(1, "plain text of a few words in a row", "en", "a", 34), (1, "plain text of a few words in a row", "en", "a", 34),
            (2, None, None, None, None), (3, "", "en", "a", 0), (None, "text without an id that goes on for a while", "en", None, 5),
            (None, None, None, None, None), (4, long, "en", "b", len(long)), (5, "x" * 200_000, None, "b", 200_000),
            (6, " \n\t ", "en", "b", 4), (6, "same id another text here", "en", "b", 4), (7, "!!! ... 123", "de", "c", 9),
            (8, "plain text of a few words in a row", "en", "a", 34)]
    names = "txt long, node long, i long, t long, id long, c0 string, rank long, length long, `key` string"
    extra = (1, 2, 3, 4, 5, "c", 7, 8, "k")
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {names}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
