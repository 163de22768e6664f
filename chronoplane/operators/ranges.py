"""One exact numbering for every order and size: ranges of rows, their counts, and a row number inside each.

Spark cuts the whole order, tie-breaks included, into as many ranges as there are shuffle partitions, by a sample of it.
So days, texts, numbers and NULLs are cut alike, one day or one first letter into many ranges; only rows that are equal in
the whole order stay together. What remains to do per range is bounded by its rows, what joins the ranges by their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.session import stored

RANGE, BEFORE = "__range", "__before"


def null_safe(left: DataFrame, right: DataFrame, cols) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__r_{c}"]) for c in cols], F.lit(True))


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with the number of their range in RANGE, NULLs first.

    Stored, because ranges come from a sample that another run might draw anew: all that follows must see the same ones.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(count, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def before_ranges(rows: DataFrame, by: list[str], size: Column, total: str | None = None) -> DataFrame:
    """`by`, RANGE, `__size`, BEFORE: what the ranges before a range sum up to, within each group.

    A row per range, and one more per group: a group whose rows follow each other spans neighbouring ranges only.
    """
    per = rows.groupBy(*by, RANGE).agg(size.alias("__size"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(BEFORE, F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    return per.withColumn(total, F.sum("__size").over(whole)) if total else per


def with_ranges(rows: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their range; without groups these are a row per range, which may be broadcast."""
    cols = [*by, RANGE]
    side = per.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    return rows.join(side if by else F.broadcast(side), null_safe(rows, side, cols)).drop(*[f"__r_{c}" for c in cols])


def numbered(df: DataFrame, order: list[Column], index: str, total: str | None = None) -> DataFrame:
    """Exact 0-based position of every row in the order of the whole table, and optionally the number of rows."""
    rows = in_ranges(df, order)
    held = with_ranges(rows, before_ranges(rows, [], F.count(F.lit(1)), total).drop("__size"), [])
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return held.withColumn(index, (F.col(BEFORE) + inside - 1).cast("long")).drop(RANGE, BEFORE)
