import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, n_lines int, score string, _text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with extra columns whose names clash with those of operators."""

    def make(rows, partitions=3):
        full = [(d, t, l, s, None if t is None else len(t), "h", 1, "s", "x") for d, t, l, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty and blank texts, a very long one, ties and repeated rows."""
    words = " ".join(f"w{i % 97}" for i in range(30_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t\n ", None, "a"),
        (4, "one two three", "en", None),
        (4, "one two three", "en", None),
        (5, words, "en", "b"),
        (6, words, "en", "b"),
        (None, "one two three", "en", "b"),
        (None, None, None, None),
        (7, "ß é 漢字 🙂 \x00 \x1c end", "fr", "c"),
    ]
