import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = ("__fp", "__text", "__words", "__site", "__key", "__drop", "__lines", "__found", "__root", "__least", "key", "line", "site", "hash", "rank", "score", "n_words", "kept")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    same = words(80, 1)
    return [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", None, 0),
        (None, same, None, "a", None), (None, words(70, 2), "en", None, None), (5, words(40_000, 3), "de", "b", 1), (6, "the " * 300, "en", "b", 1),
        (7, "\n\n \t\n", None, "b", 1), (8, "\x00     é ß İ 漢字 🙂 \x0b\x0c", "fr", "b", 1), (9, "one", "fr", "b", 1),
        (10, "a line of text\n" * 60 + words(60, 4), "de", "b", 1), (11, words(30, 5) + " ### *** $$$ " * 20, "de", "a", 1), (12, same + " " + words(5, 6), "en", "a", 1),
    ]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
