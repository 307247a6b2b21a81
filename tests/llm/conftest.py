import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with added ones."""
    rows = [
        (0, "alpha beta gamma delta epsilon zeta", "en", 1),
        (1, "alpha beta gamma delta epsilon zeta", "en", 1),
        (1, "alpha beta gamma delta epsilon zeta", "en", 1),
        (2, None, "en", None),
        (3, "", None, 2),
        (4, " \n\t ", "de", 2),
        (5, "alpha\nbeta gamma\x0bdelta epsilon zeta", "de", 3),
        (6, "wort " * 30_000, "de", 3),
        (7, "1234 !!", "fr", 3),
        (8, "x" * 3000, "fr", 4),
        (9, "naïve café 漢字 ١٢٣ 🙂\x1c end", "fr", 5),
        (None, "no identifier here at all", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").withColumnRenamed("kept", "n_lines")
