import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind, with columns that clash with names used inside operators."""
    long = "word " * 5000 + "end"
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one two three four five six", "en", "b", 27),
        (4, "one two three four five six", "en", "b", 27), (5, "one two three four five six", "en", "b", 27), (None, "no id here at all", "en", "b", 17),
        (6, long, "en", "b", len(long)), (7, "x" * 20000, "de", "c", 20000), (8, "漢字 🙂 é\u0000 ▁ tab\tend", "fr", "c", 9), (9, "Die Straße. " * 30, "de", None, 360),
    ]
    extra = "fp long, key string, score double, size long, shard int, slot long, row string, u long, label int, shards int, digest string, ids string"
    return spark.createDataFrame([(*r, 7, "k", 0.5, 1, 2, 3, "r", 4, 5, 6, "d", "i") for r in rows], f"{COLUMNS}, {extra}")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0), "extra") for i in range(12)] + [(None, 1, 1, None), (3, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")
