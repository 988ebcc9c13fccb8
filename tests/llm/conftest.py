import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, ties, and columns that clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 39),
        (1, "one two three four five six seven eight", "en", "a", 39),
        (2, "one two three four five six seven eight", "en", "a", 39),
        (2, "another text under the same number here", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 4),
        (None, "no number but words enough to count", "en", "b", 1),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, "Zürich \\ <b> ### 漢字 \u0001 \u0003 x@y.zz", "de", "c", 5),
        (8, "two words", "en", "a", 9),
    ]
    clash = "score double, predicted int, component_id string, n_copies string, copy string, id string, __id string, clean_text string, n_email string, spans string, shard string"
    df = spark.createDataFrame([(*r, 0.5, 9, "c", "n", "p", "i", "j", "t", "e", "s", "h") for r in rows], f"{DOCS}, {clash}")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
