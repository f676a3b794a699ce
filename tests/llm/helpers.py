"""Inputs that every corpus operator has to stand: gaps, long texts, repeats, empty tables, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def prose(seed: int, words: int, vocabulary: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def odd_rows() -> list[tuple]:
    long = " ".join(prose(k, 200, 5000) for k in range(60))
    rows = [
        (1, "one two three four five six", "en", "a", 27), (2, None, "en", "a", None), (3, "", "fr", None, 0), (4, " \n\t ", None, "b", 4),
        (5, long, "en", "b", len(long)), (6, long + " tail", "en", "b", None), (7, "Ünï cödé 漢字 \U0001F600 word", "de", "c", None),
        (8, "one two three four five six", "en", "c", 27), (8, "one two three four five six", "en", "c", 27), (None, "no key here at all", None, None, None),
        (None, None, None, None, None),
    ]
    return rows + [(100 + k, prose(k, 120), "en", "a", None) for k in range(6)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
