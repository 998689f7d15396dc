import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table of (doc_id, text) pairs, with extra columns that clash with internal names."""
    def of(rows, **more):
        full = [(i, t, more.get("lang", "en"), more.get("source", "src0"), None if t is None else len(t), "x", 1.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, line string, score double")

    return of


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "word " * 30_000), (6, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "é▁ \U0001f600\x00\n" * 5)]


@pytest.fixture
def odd(docs):
    """Nulls, empty, blank, very long and equal texts, a repeated row and a row without an id."""
    return docs([*ODD, ODD[5]])
