import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns whose names clash with results."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long, id long, k long, n long, h string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 1, 2, 3, 4, "h") for i, t in rows], schema).repartition(3)

    return make


LONG = " ".join(f"w{k * k % 9973}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all here"), (6, LONG), (7, LONG + " end"), (8, "日本語 текст é ñ"), (9, "a" * 200_000)]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
