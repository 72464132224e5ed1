"""Small tables that every operator must live with."""

from __future__ import annotations

TEXT_SCHEMA = "doc_id bigint, text string, score double, ids int, lang string"

# Null and empty cells, ties and repeated rows, a very long text, and extra columns with the operators' own names.
ODD_TEXTS = [
    (1, "the quick brown fox", 0.5, 1, "en"),
    (1, "the quick brown fox", 0.5, 1, "en"),
    (2, "", None, 2, None),
    (3, None, 0.1, None, "en"),
    (None, "a text without an id", 0.1, 4, "en"),
    (5, "ñ é 日本語 🎉  　 x", 0.1, 5, "es"),
    (6, "word " * 60_000, 0.1, 6, "en"),
    (7, "x" * 50_000, 0.1, 7, "en"),
    (8, " \n\t ", 0.1, 8, "en"),
    (-9, "!?!? ... ---", 0.1, 9, "en"),
]


def odd(spark):
    return spark.createDataFrame(ODD_TEXTS, TEXT_SCHEMA)


def none(spark):
    return spark.createDataFrame([], TEXT_SCHEMA)
