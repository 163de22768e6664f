"""Writing feature tables, folds and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple


def write_table(df: DataFrame, path: str, keys: Keys, partition_by=(), mode: str = "overwrite") -> None:
    """Parquet, rows of an entity close together and in time order.

    A range partitioning on (entity, time) splits a huge entity over several files instead of one task.
    """
    cols = [*keys.entity, keys.time, *keys.event]
    ordered = df.repartitionByRange(*[F.col(c) for c in cols]).sortWithinPartitions(*as_tuple(partition_by), *cols)
    writer = ordered.write.mode(mode)
    parts = as_tuple(partition_by)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_folds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per fold and part, so that reading a fold reads only its files."""
    df.write.mode(mode).partitionBy("fold", "split").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
