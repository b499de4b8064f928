import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, curve string, shard int, fp string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of some (doc_id, text), with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        data = [(i, t, ("en", "de", None)[(i or 0) % 3], f"src{(i or 0) % 4}", None if t is None else len(t), "x", 7, "y") for i, t in rows]
        return spark.createDataFrame(data, DOCS).repartition(partitions)

    return make


#: null, empty, blank, one character, very long, repeated and tied texts; a null id.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "lorem ipsum dolor sit amet " * 20_000), (6, "same text here"), (7, "same text here"), (8, "é" * 700), (9, "a" * 5_000), (9, "a" * 5_000), (None, "no id at all")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def real():
    """The smallest documents table, in pandas."""
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id").reset_index(drop=True)
