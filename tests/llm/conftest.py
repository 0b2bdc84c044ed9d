import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, fp string, component string, _salt int, rank int, shard string, id string, b int, k int, label int, words int, host string, x int, p double, copies int"
EXTRA = (1, "z", "z", 2, 3, "q", "r", 4, 5, 6, 7, "h", 8, 0.5, 9)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def messy_rows():
    """Nulls everywhere, empty, white and very long texts, ties, repeated rows and ids."""
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(r.choices(words, k=120))
    near = base.replace("w1 ", "w1x ", 1)
    return [
        row(5, base), row(3, base), row(5, base), row(9, near), row(1, base.upper()), row(2, None), row(4, ""), row(6, " \n\t "), row(7, "one"), row(7, "two words"),
        row(None, base), row(None, None), row(None, "only here and nowhere else at all"), row(8, "x" * 30_000), row(10, " ".join(r.choices(words, k=20_000))), row(11, "line\n" * 50),
        row(12, "\U0001f600 ünï café 日本", None, None), row(-3, "minus", "de", ""), row(2**62, "large id " * 9, "fr", "s"), *[row(100 + i, " ".join(r.choices(words, k=60)), r.choice(["en", "de", None]), f"s{i % 3}") for i in range(30)],
    ]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(100 + i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, None), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
