import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns whose names operators use inside."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base, line = prose(80), "This very line is found in a good many documents"
    rows = [
        (1, None, "en", "a", None, "x", 1),
        (2, "", "en", None, 0, None, None),
        (3, " \t\n\x0b\r ", None, "a", 6, "x", 2),
        (4, base, "en", "a", len(base), "x", 3),
        (5, base, "en", "a", len(base), "x", 3),
        (5, base, "en", "a", len(base), "x", 3),
        (6, base.upper(), "en", "b", len(base), "x", 4),
        (7, prose(60_000), "en", "b", 1, "x", 5),
        (8, "Ünïcödé 　 words 你好 \U0001f600 " + prose(70), "de", "b", 1, "x", 6),
        (None, base + " tail", "en", "a", 1, "x", 7),
    ]
    rows += [(10 + i, f"{prose(55)}\n  {line if i % 2 else line.upper()}\t\n{prose(10)}", "en", "a", 1, "x", i)
             for i in range(7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
