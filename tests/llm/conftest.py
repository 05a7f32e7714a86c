import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and blank texts, a very long one, repeated rows, ties."""
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "straße", "niño", "Été", "日本"]
    long = " ".join(random.choice(words) for _ in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, long, "en", "s", len(long)),
        (5, "one two three four five six", "en", None, 27), (5, "one two three four five six", "en", None, 27),
        (None, "one two three four five six", None, "s", None), (None, None, None, None, None), (6, "123 456 !!", "de", "s", 10),
        (7, "x▁y a\x00b \x1c c", "fr", "s", 9), (8, "word", "es", "s", 4), (9, "日本 テキスト", None, None, 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sentences():
    """Invented sentences with a fixed seed."""
    def make(count, size=40, seed=1, letters="abcdefghij"):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)]
        return [" ".join(rng.choice(vocabulary) for _ in range(size)) for _ in range(count)]

    return make
