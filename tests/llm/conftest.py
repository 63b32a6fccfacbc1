import random

import pytest

SCHEMA = "doc_id long, text string, lang string, slot string, _part string, n_chars long, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text) with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "xx", "s", "p", len(t or ""), 0.5) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random invented words, n of them, the same for the same seed."""

    def make(n, seed=0, size=9):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, size))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows that every operator has to stand: nulls, empties, repeats, ties, a very long text, odd characters."""
    long = prose(60_000, 99)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id at all, but a text."), (None, None), (5, long), (6, "ÀÉ ñandú 漢字 \U0001f600 a\x0bb\x1cc d <|endoftext|> e"), (7, prose(80, 1)), (8, prose(80, 1)), (7, prose(80, 1))]
