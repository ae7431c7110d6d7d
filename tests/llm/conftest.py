import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A DataFrame of rows under a schema, in several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


#: Rows that every operator on documents must take: nulls, empty and long texts, repeated rows, ties.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "The quick brown fox is in the garden of a house. " * 400),
    (6, "The quick brown fox is in the garden of a house. " * 400), (7, "!!! ??? ..."), (8, "é ß 漢字 😀 ünïcode " * 20), (None, "no id here"),
    (None, "no id here"), (9, "a\n\nb\n" * 50),
]


@pytest.fixture
def odd():
    return ODD
