"""Fixtures of these tests; the session is that of the folder above."""

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, copies, equal rows, and columns named like results."""
    passage = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [
        (1, f"start here {passage} and an end of its own", "en", "a", 5),
        (2, f"something else {passage}", "en", "b", 5),
        (3, passage, "en", None, 5),
        (3, passage, "en", None, 5),
        (4, None, "en", "a", None),
        (5, "", None, "a", 0),
        (6, " \t\n ", "en", "c", 4),
        (7, long, "de", "a", len(long)),
        (8, long + " more", "de", "a", len(long) + 5),
        (9, "Ünïcode 日本語 \U0001f600 text\r\nwith\x0bodd\x0cspace", "xx", "\U0001f600", 40),
        (None, f"{passage} without an id", "en", "b", 1),
        (None, None, None, None, None),
        (10, "same same same same same same same same same same same same", "en", "b", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "size target taken pieces fingerprint component_id span id row key words lines kept start length score at path place bucket".split()
    clash = docs
    for n in names:
        clash = clash.withColumn(n, F.lit("clash"))
    return docs, clash


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
