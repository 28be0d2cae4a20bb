import random

import pytest

from corpus_texts import prose

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use for themselves
    "id long, key string, row long, score double, shard int, component long, spans string, n long, edits string, word string"
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text[, lang])`` rows, with columns whose names clash."""

    def build(rows):
        extra = (7, "k", 1, 0.5, 3, 9, "s", 2, "e", "w")
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), *extra) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, one-word, very long, tied, repeated, and without an id."""
    rng = random.Random(3)
    text = prose(rng, 120)
    near = text.split()
    near[60] = "changed"
    long = prose(rng, 30_000, 5_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, text), (7, text), (7, text), (8, " ".join(near)),
        (9, text.upper()), (None, text), (None, None), (10, "It’s ÉTÉ… 日本語 🎉 \x00\x1c end"), (11, "same same same same same same"),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def none(make):
    return make([])
