"""Odd documents that every operator must take, and what the operators' own tests share."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, tag string, kept string"
LONG = "lang wort und text " * 6000

#: Nulls in every column, empty and blank and very long texts, repeated rows and ids; extra columns clash with names inside.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs into the wood.", "en", "a", 67, 1, 0.5, "t", "k"),
    (1, "The quick brown fox jumps over the lazy dog and runs into the wood.", "en", "a", 67, 1, 0.5, "t", "k"),
    (1, "Another text that shares the id of the first one, which is odd.", "en", "b", 63, None, None, None, None),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0, 0.0, "", ""),
    (4, " \n\t \n", "de", "b", 5, 0, 0.0, "", ""),
    (5, LONG, "de", "a", len(LONG), 0, 0.0, "", ""),
    (6, LONG, "de", "c", len(LONG), 0, 0.0, "", ""),
    (None, "A text without an id, with a 😀 and 1.2.3.4 in it.", None, "a", None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (7, "12345 !!! ...", "fr", None, 13, None, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
