import pytest


@pytest.fixture
def docs_of(spark):
    """A table of documents from (doc_id, text) rows, with extra columns whose names clash with those of operators."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, kept boolean, component_id long, ids binary, wc__score double, wc__n_lines long, wc__failed string"
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, 1, True, 7, b"x", 0.1, 2, "f") for i, t in rows], schema)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 60_000), (5, "word " * 60_000), (None, "no id " * 30), (6, "<|endoftext|> é ñ 日本 \x0b"), (7, "a b c d e f"), (8, "a b c d e f")]


@pytest.fixture
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return ODD
