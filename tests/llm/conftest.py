import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, t string, k string, size string, shard int, n_words string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]), with extra columns whose names the operators use inside."""

    def make(*given):
        filled = [(i, text, "en", rest[0] if rest else "s", len(text or ""), "r", "t", "k", "z", 7, "n") for i, text, *rest in given]
        return spark.createDataFrame(filled, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and a very long word."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return make_docs(
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three", None), (None, "a b c d e f g"), (6, long), (7, long, None), (8, "y" * 70_000), (9, "é ß 漢字 😀 Éa"),
    )
