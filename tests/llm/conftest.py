import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, value string, rep string, n int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with further columns whose names the operators use inside."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", len(t or ""), "x", 0.5, None, "r", 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty, blank and very long texts, ties, repeated rows and ids, a null id."""
    long = "word " * 40_000 + "x" * 60_000
    return docs(
        [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "same text here now ok"), (6, "same text here now ok"),
         (7, "same text here now ok"), (7, "same text here now ok"), (8, "one"), (8, "another text of the same id"),
         (None, "same text here now ok"), (9, "ÉCOLE été 日本 🙂 <|endoftext|> +1 (366) 555-9807"), (-10, "!!! ???")]
    )


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
