import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def messy(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    long = "Wort " * 30_000 + "Ende"
    rows = [
        (5, "Some words that stay here", "en", "b", 1), (3, "Some words that stay  here", "en", None, 2), (3, "Some words that stay  here", "en", None, 2),
        (7, None, None, "a", None), (8, "", "fr", "a", 0), (9, " \n\t", None, "é", 3), (None, "no id at all", None, "a", 5), (None, None, None, None, None),
        (11, long, "de", "b", 6), (12, long, "de", "b", 6), (13, "▁ mark  and 日本語 ①👍", "ja", "Z", 7), (14, "123 456", "en", "Z", 8), (15, "x", "en", "a", 9),
    ]
    extra = "id long, fp long, content string, size string, part int, run int, bucket int, key long, shard long, ids string, `rows` string"
    clash = [(*r, 1, 2, "c", "s", 3, 4, 5, 6, 7, "i", "r") for r in rows]
    return spark.createDataFrame(clash, f"{DOCS}, {extra}")


@pytest.fixture
def none(messy):
    return messy.filter("false")
