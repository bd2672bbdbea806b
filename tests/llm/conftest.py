import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
CLASH = ["h1", "key", "d", "mark", "line", "w", "fp", "first", "words", "base", "spans", "block", "part", "deal", "_row", "kept"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeiounrstl") for _ in range(rnd.randint(2, 9))) for _ in range(vocabulary)] + ["the", "of", "and", "to", "a"] * 30
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Awkward documents: nulls, empty and long texts, ties, repeated rows, copies."""
    body = prose(1, 120)
    out = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \t\n\x0b\f\r ", "xx", "s", 7),
        (4, body, "en", "s", len(body)),
        (5, body, "en", "s", len(body)),
        (5, body, "en", "s", len(body)),
        (None, body, None, "s", None),
        (6, body.replace(" ", "\n"), "en", "s", 1),
        (7, prose(2, 60) + "\n" + body, "fr", "s", 1),
        (8, "x" * 30_000, "en", "s", 1),
        (9, "word " * 9_000, "en", "s", 1),
        (10, prose(3, 9_000, 4_000), "de", "s", 1),
        (11, "mail a.b@c.de, call +1 (017) 555-7713, 10.0.0.1, 4111 1111 1111 1111", "en", "s", 1),
        (12, 'Ünïcödé 😀 "quotes" <|endoftext|> É́  x <|startoftext|>', "es", "s", 1),
        (None, None, None, None, None),
    ]
    return out


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def awkward(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
