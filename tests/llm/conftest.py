"""Odd rows that every operator has to take: nulls, empty and long texts, repetitions, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = {"en": "the and of ing tion er on re he is".split(), "fr": "eau ou é ment queu le ai è ç oi".split()}


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


ODD = [
    (1, prose(1, 80), "en"),
    (1, prose(1, 80), "en"),  # a repeated row
    (2, prose(2, 80), "en"),
    (3, None, "en"),
    (4, "", "fr"),
    (None, prose(3, 60, "fr"), "fr"),
    (None, None, None),
    (5, "   \n\t ", None),
    (6, "!!! ??? 123 ###", "en"),
    (7, "é" * 5000, "fr"),
    (8, prose(4, 20_000), "en"),
    (9, "a\0b \U0001f600 ‮ x", "en"),
    (10, prose(1, 80), "en"),
]
EXTRA = {"key": "k", "h": 1, "sig": 2, "conf": 3, "node": 4, "root": 5, "keep": False, "score": 1.5, "rank": 9, "term": 7, "n": 8, "row": "r", "was_null": True, "query": 3, "_id": 5, "_hash": 6, "part": 1, "lang_id": "x"}


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named as the operators' own."""
    return odd.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def written():
    return prose
