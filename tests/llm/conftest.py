import pytest

#: Rows that every operator must take: nulls, empty and odd texts, repeated rows, ties, a clashing column.
ODD = [
    (1, "Hello there, this is a text of some words that go on.", "en", "s1", 5),
    (1, "Hello there, this is a text of some words that go on.", "en", "s1", 5),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \n\t ", "de", None, 3),
    (None, "A row without an id", "en", "s2", 1),
    (5, "x" * 30_000, "en", "s2", 2),
    (6, "Hello there, this is a text of some words that go on.", "en", "s3", 5),
    (7, "one two", None, "s1", 2),
    (8, "<|endoftext|> mail me@x.org or +1 555 123 4567\nHello", "en", "s2", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "row")


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)
