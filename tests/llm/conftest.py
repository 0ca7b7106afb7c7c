import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, _text string, start int, _w int"


def edge_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing extra columns, odd white space."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    near = [f"z{i}" for i in range(300)]
    rows = [
        (1, "Hello world.\nHello world.\n\n a  b\tc\x0bd\x0ce\r\nf", "en", "s"),
        (2, None, None, None),
        (3, "", "en", "s"),
        (4, " \n\t ", "en", None),
        (5, " ".join(words), "en", "s"),
        (6, "same text here for two", "en", "s"),
        (7, "same text here for two", "en", "t"),
        (7, "same text here for two", "en", "t"),
        (None, "a row without an id " * 8, "en", "s"),
        (9, "one two three four five six seven eight " * 5, "en", "s"),
        (10, "é́ 漢字 \U0001f600 #*$ Apache   License, GNU general-public LICENSE", "fr", "s"),
        (11, " ".join(near), "en", "s"),
        (12, " ".join([*near[:150], "changed", *near[151:]]), "en", "s"),
        (13, "x" * 5000, "en", "s"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "clash", "clash", 5, 6) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
