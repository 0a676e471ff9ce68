from __future__ import annotations

import pytest

WORDS = "the of and cat dog runs over lazy river bank stone light under green sky open door hill road wind rain tree leaf boat fish bird song".split()


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented sentences."""
    import random

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns whose names clash with results."""
    long = prose(1, 30_000)
    rows = [
        (1, long, "en", "a", len(long), 5, 0.1), (2, long, "en", "a", len(long), 5, 0.1), (3, "", "en", "b", 0, None, None), (4, None, None, None, None, 7, None),
        (None, "a text without an id but with words enough", "en", "b", 1, 1, 1.0), (5, prose(2, 40), "en", "a", 1, 1, 1.0), (5, prose(2, 40), "en", "a", 1, 1, 1.0),
        (6, "@@@ ... 123 !!!", "en", "c", 1, 1, 1.0), (7, "é ü ß", "de", "c", 1, 1, 1.0), (None, None, None, None, None, None, None), (8, "x", None, "c", 1, 1, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double")
