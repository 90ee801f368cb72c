"""Small tables with every awkward row an operator may meet."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, kind string, fp string, word string, host string"
CLASHING = ("a", "b", "c", "d", "e")


def rows(pairs):
    return [(i, t, "en", "s", None if t is None else len(t), *CLASHING) for i, t in pairs]


@pytest.fixture(scope="session")
def make(spark):
    def build(pairs):
        return spark.createDataFrame(rows(pairs), SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward():
    text = "One two three four five six seven eight nine ten eleven twelve."
    return [
        (None, None), (None, "no id"), (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, text), (5, text), (6, text), (6, "another text under one id"),
        (7, "a " * 5000), (8, "x" * 30_000), (9, "ÀÉ 日本語 \U0001f600 ÉCOLE"), (10, "two words"), (-11, text.upper()), (12, "\x00 \x1f|#$"),
    ]
