import pytest

LONG = "Ein langer Text mit vielen Worten und noch mehr " * 4000


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, very long, tied and repeated rows."""
    return [
        (1, "", "a"), (2, None, "a"), (3, LONG, "b"), (4, "one two three four five six", None), (5, "one two three four five six", "b"),
        (5, "one two three four five six", "b"), (None, "a text without an id", "a"), (6, "ÉÀ \x00 Straße\n\nline\nline", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns named like those the operators give out."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, source string")
    clash = "score predicted held_out fp ids decoded kept_text n_lines n_dropped weight block n hash range".split()
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clash])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
