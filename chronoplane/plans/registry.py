"""Registered queries: an operator bound to the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
# Means of decimals often end in exactly half a unit of the last digit, where two engines may round apart.
# Both sides add this shift, far below the last digit, so that such values are no longer halves.
SHIFT = 2.7182818e-08
_INTEGERS = (T.IntegerType, T.ShortType, T.ByteType)


class Tables:
    """The test tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str, hot_rows: int | None = 1_000_000):
        self.spark, self.folder, self.hot_rows = spark, folder.rstrip("/"), hot_rows

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function (Tables) -> DataFrame under the operator's name."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded (without a negative zero), integers as longs: what is compared with the SQL result."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + SHIFT, DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, _INTEGERS):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expression: str, name: str) -> str:
    """SQL select item rounded like `presented`."""
    return f"round(CAST({expression} AS DOUBLE) + {SHIFT}, {DIGITS}) + 0e0 AS {name}"


def n(expression: str, name: str) -> str:
    """SQL select item as BIGINT."""
    return f"CAST({expression} AS BIGINT) AS {name}"
