import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "One two three four five six seven.", "en", "a", 34),
    (1, "One two three four five six seven.", "en", "a", 34),
    (2, None, None, None, None),
    (None, "A row without an id.", "en", "a", 20),
    (4, "", "en", None, 0),
    (5, LONG, "en", "b", len(LONG)),
    (6, " \t\n ", "en", "b", 4),
    (7, "One two three four five six seven.", "fr", "a", 34),
    (8, "Ünïcödé ñandú é 日本語 🙂 ſ K", "xx", "b", 25),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["fp", "a", "b", "node", "component", "bucket", "score", "length", "tokens", "key", "h", "pos", "words", "__t", "__n", "__d", "__text", "__score", "__starts", "__stops", "__ranges", "__spans", "starts", "stops", "t", "n", "first", "group", "main", "seen", "flat"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, COLUMNS).withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
