"""Awkward documents that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = "label keep toxic row a b hash set bucket root members least n rank bin_id piece n_tokens quality_score x fold path host rid lines".split()


def prose(seed: int, words: int = 120) -> str:
    rng = random.Random(seed)
    vowels, consonants = "aeiou", "bcdfghklmnprstvw"
    vocabulary = ["".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    common = "the of and to in is it that".split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(words))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join("changed" + str(rng.randint(0, 9)) if rng.random() < share else w for w in text.split())


LONG = prose(77, 60_000)
ROWS = [
    (1, prose(1), "en", "s", 1), (2, prose(1), "en", "s", 1), (3, edited(prose(1), 3, 0.02), "en", None, None), (4, prose(4), None, "s", 1),
    (5, None, None, None, None), (6, "", "en", "s", 0), (7, "   \n ", "en", "s", 4), (8, "word", "en", "s", 4), (9, "é" * 50_000, "fr", "s", 1),
    (10, LONG, "en", "s", len(LONG)), (11, LONG + " tail", "en", "s", 1), (None, prose(12), "en", "s", 1), (None, None, None, None, None),
    (13, prose(13), "en", "s", 1), (13, prose(13), "en", "s", 1), (14, "日本語 テキスト " * 30, "ja", "s", 1), (15, "a b", "en", "s", 3),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def wide(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
