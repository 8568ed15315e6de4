import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text, source) rows, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, "x", 1, None) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, `_key` string, target int, taken string")

    return make


@pytest.fixture(scope="session")
def prose():
    """Distinct invented sentences: prose(seed, words)."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows with nulls, empties, white space alone, ties, repeats and one very long text."""
    return [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "Word", "a"), (4, "Word", "a"), (None, prose(1, 30), "b"), (None, None, None),
            (5, prose(2, 60), "b"), (6, prose(2, 60), "b"), (7, "é😀 \xa0ß 　 x", "c"), (8, prose(3, 60_000), "c")]
