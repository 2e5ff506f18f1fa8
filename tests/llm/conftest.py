import pytest

ENGLISH = "The quick brown fox jumps over the lazy dog near the river bank. It was a cold day in the small town. Nobody saw what happened there that night. "
LONG = ENGLISH * 2 + " ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(40_000))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, ENGLISH, "en", 1.0, "a"),
        (2, None, "en", None, None),
        (3, "", None, 2.0, "b"),
        (4, "   \n\t ", "en", 2.0, "b"),
        (5, "12345 67890 !!! ???", "en", 2.0, "b"),
        (6, LONG, "en", 2.0, "b"),
        (7, ENGLISH, "en", 2.0, "b"),
        (7, ENGLISH, "en", 2.0, "b"),
        (None, "a text without a number of its own, which says little", "en", 2.0, "b"),
        (8, "ÄÖÜ ß éè ñ 漢字 \U0001f600 word", "de", 2.0, "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, cover string").selectExpr("*", "score as node", "cover as rank", "score as n_sentences", "1 as row", "2 as key", "3 as word", "4 as uid", "5 as rest", "6 as item", "lang as lang_pred")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
