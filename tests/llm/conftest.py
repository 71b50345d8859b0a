import pytest

EXTRA = "uid long, n long, rank int, shard int, cls long, size string, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and white texts, ties, repeated rows, one very long text, further columns with clashing names."""
    base = " ".join(f"word{i} und" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more words", "en", None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, " \t\n ", "de", "b"), (7, "One", "de", "c"), (8, "one", "de", "c"), (9, "one two", None, None), (None, base.upper(), None, None), (10, "12 34 !?", "fr", "c"),
        (11, "der die das und nicht", "de", "é"), (12, "text <|endoftext|> special 漢字 ﬁ é İ", "en", "z"), (13, "x" * 30 + " " + " ".join(f"long{i % 977}" for i in range(60_000)), "en", "z"),
        (14, "Copyright (c) 2020 me\nReleased under the MIT Licence.", "en", "z"), (15, "the of and with this that from " * 9, "en", "a"),
    ]
    rows = [(*r, 5, 5, 5, 5, 5, "s", "l") for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 15, 11, 13)] + [(None, 1, 0), (7, None, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
