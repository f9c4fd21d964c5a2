"""Small tables that hold what real ones may: nulls, empty texts, ties, repeated rows, extra columns."""

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with a null text, an empty one, repeated rows and columns whose names clash with results'."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven. Twelve!", "en", 5),
        (2, None, None, None),
        (3, "", "en", 0),
        (4, "  \n\t ", "de", 1),
        (5, "Straße ünïcode — 漢字 <|endoftext|> ▁x", "de", 7),
        (5, "Straße ünïcode — 漢字 <|endoftext|> ▁x", "de", 7),
        (6, "word " * 3000, "en", 9),
        (7, "a-b_c 12 x.\n\nlast line", "fr", 2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
