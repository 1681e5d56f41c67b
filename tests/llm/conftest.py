import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, many kinds of space."""
    words = " ".join(f"w{i}" for i in range(130))
    return [
        (1, "hello  world \n again", "en", "a", 20),
        (2, "hello world again", "en", "a", 17),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n\x0b\x0c\r ", "fr", "b", 6),
        (None, "no id here", "en", None, 10),
        (None, None, None, None, None),
        (7, words, "en", "a", len(words)),
        (8, "start " + words + " end", "en", "a", 1),
        (8, "start " + words + " end", "en", "a", 1),
        (9, " ".join(f"w{i}" for i in range(20, 90)), "de", "a", 1),
        (10, "x" * 30_000, "en", "c", 1),
        (11, "Ünï cödé 漢字 テスト 🙂🙂   nbsp em <|endoftext|> x<|endoftext|>y", "fr", "c", 1),
        (12, "it's we'll 'r e  a   b\n\n c \n", "en", "c", 1),
        (13, ("lorem ipsum dolor sit amet " * 3000).strip(), "es", "c", 1),
        (14, "1234 567", "en", "c", 8),
        (15, words, "en", "z", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
