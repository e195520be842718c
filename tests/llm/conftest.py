import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest_llm import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts, languages and sources; empty, blank and very long texts; repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 40), "en", "a", 1),
        (1, prose(2, 40), "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "fr", "b", 4),
        (None, prose(3, 30), "fr", None, 5),
        (None, None, "de", "c", None),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "", len(long)),
        (7, "x", "en", "c", 1),
        (8, "日本語 тест é́ \U0001f600 a b", "ja", "c", 9),
        (9, "a" * 200_000, "en", "c", 200_000),
        (11, "1" * 100_000 + ".2.3", "en", "c", 100_004),
        (12, "alpha " * 30_000, "en", "c", 180_000),
        (10, prose(2, 40) + " end", None, "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The same rows with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("shard", "slot", "size", "cell", "rank", "row", "n", "cls", "keys", "label", "fold", "score", "h", "found", "positions", "ids", "at", "held_out", "found_", "total", "text_crc32", "n_words", "__row", "__id", "__doc", "__own", "__crc", "source_key", "stays")
    return odd.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
