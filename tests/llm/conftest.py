import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, row string"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and extra columns with common names."""
    rng = random.Random(5)
    words = ["the", "of", "alpha", "beta", "gamma", "delta", "der", "und", "haus", "maison"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 3000)) for _ in range(60_000))
    texts = [
        None, "", " \n\t ", "one two", "One TWO", "é ß 日本 😀", "a" * 5000, "\x00\x1f", "!!! ???", long, long + " tail",
        "mail me: jo.doe@mail.example.com or +1 (499) 555-6503, 4111 1111 1111 1111, 10.0.0.255", "Licensed under CC BY-NC 4.0.",
    ]
    out = [(k, t, "en" if k % 2 else "de", None if k % 3 else "s", len(t or ""), "x", 1, "y") for k, t in enumerate(texts)]
    out += [(5, texts[5], "en", "s", 4, "x", 1, "y"), (3, "one two", None, None, None, None, None, None), (None, "one two", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (2**62, "big id of the table", "en", "s", 1, "x", 1, "y")]
    return spark.createDataFrame(out, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
