import pytest

LONG = " ".join(f"wort{k % 977}x{k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names the operators use inside."""
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "ein Wort", "de", "a"), (4, "ein Wort", "de", "a"), (None, "ein Wort", "de", "b"),
        (5, LONG, "en", "b"), (6, LONG, None, None), (7, "Äß €\n\U0001f600 don't  x" * 9, "de", "b"), (8, "a b c", "en", "a"), (9, "a b c", "en", "a"), (10, "\x00\x01 null", "en", "c"),
    ]
    extra = [(*r, len(r[1] or ""), k, k, "p", 1.5, "x") for k, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, block long, key long, payload string, score double, label string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(1, 11)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
