from __future__ import annotations

import pytest

TEXTS = [
    None, "", " ", "\n", "a", "A b  c\td", "Same line of more than twenty letters\nother",
    "same line of more than TWENTY letters \nthird\n", "  same LINE of more than twenty letters",
    "Wörter über Größe 😀 und 日本 text\nüber ÄÖ über ÄÖ über ÄÖ", "repeat " * 400, "x" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, repeated and long rows, with columns whose names clash with results."""
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)]
    rows += [(3, "\n", "en", 1), (None, "A b  c\td", None, None), (20, "Ab c d", "en", 2), (21, "aBcd", "en", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, n_lines int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
