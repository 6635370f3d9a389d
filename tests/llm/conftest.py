import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, ties, a very long text, clashing column names."""
    long = "word " * 500_000 + "end"
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t ", 5), (4, "same text of a few words here", 5), (4, "same text of a few words here", 5), (5, "same text of a few words here", None), (6, "Ärger, it's 3.5 €!  \n\n x", 7), (7, long, 8), (8, "one", 9), (None, "no key at all", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score int")
