from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, digest string, `value` double, part string, _hash string, _digest string, found string, row_hash string"


def rows_of(*texts_by_id):
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", "d", 0.5, "p", "h", "g", "f", "r") for i, t in texts_by_id]


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents with more columns, whose names clash with those that the operators use."""

    def build(*texts_by_id):
        return spark.createDataFrame(rows_of(*texts_by_id), SCHEMA).repartition(3)

    return build


WORDS = [f"w{k}" for k in range(200)]
LONG = " ".join(f"word{k % 977} über-{k}," for k in range(30_000))
BODY = " ".join(WORDS)

#: null and empty texts, one sign, white space only, ties, repeated rows, rows without an id, a very long text
EDGES = [(1, None), (2, ""), (3, "a"), (4, " \t\r\n"), (5, BODY), (6, BODY), (6, BODY), (7, BODY + " tail"), (None, BODY), (None, None), (8, LONG), (9, "Ünïcödé ’s  x y 𝔘𝔫𝔦 <|endoftext|>"), (5, "other text with the same id")]


@pytest.fixture(scope="session")
def edges(make):
    return make(*EDGES)


@pytest.fixture(scope="session")
def empty(make):
    return make(*EDGES).filter("false")
