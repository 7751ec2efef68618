import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, and columns whose names clash."""
    rnd = random.Random(5)
    base = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(300))
    near = base.split()
    near[7], near[150] = "changed", "words"
    rows = [
        (1, base, "en", "s", len(base), 1.0, "x"),
        (2, base, None, "s", None, None, None),
        (3, " ".join(near), "en", None, 5, 2.0, "y"),
        (4, "", "en", "s", 0, 0.0, ""),
        (5, None, "en", "s", None, None, None),
        (6, "one", "de", "s", 3, 1.0, "z"),
        (6, "one", "de", "s", 3, 1.0, "z"),
        (7, "Ünïcödé 𝄞 words, " * 3000, "xx", "s", 1, 1.0, "q"),
        (None, "lost document without a name", "en", "s", 1, 1.0, "w"),
        (8, "word" * 20000, "en", "s", 1, 1.0, "v"),
        (9, "\n \t ", "en", "s", 1, 1.0, "v"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
