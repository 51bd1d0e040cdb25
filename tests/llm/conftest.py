import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing, empty, blank, short and long texts, ties, repeated rows, NULL keys and sources."""
    random.seed(5)
    words = ["ante", "bore", "cedar", "dune", "ebb", "fjord", "Grün", "é", "naïve", "中文", "don't", "x1", "--", "|"]

    def prose(n):
        return " ".join(random.choice(words) + random.choice(["", "", ",", ".\n"]) for _ in range(n))

    base = prose(400)
    near = base.split(" ")
    near[200] = "changed"
    passage = prose(60)
    rows = [
        (1, base, "en", "a", 0),
        (2, base, "en", "a", 0),
        (2, base, "en", "a", 0),
        (3, " ".join(near), "en", "b", 0),
        (4, None, "en", "b", 0),
        (5, "", "de", None, 0),
        (6, " \n\t", "de", None, 0),
        (7, "one two", None, "c", 0),
        (8, "one  two", None, "c", 0),
        (9, prose(30) + passage + prose(20), "fr", "c", 0),
        (10, prose(25) + passage + prose(35), "fr", "é", 0),
        (11, "spam " * 3000, "fr", "a", 0),
        (12, "<|endoftext|> is a token's string", "en", "a", 0),
        (None, prose(70), "en", "a", 0),
        (None, None, None, None, None),
        *((100 + i, prose(random.randint(1, 300)), "en", random.choice("abc"), 0) for i in range(40)),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
