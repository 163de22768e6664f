"""Exact quantiles without sorting a group in one task.

The built-in exact percentile keeps all distinct values of a group in one aggregation buffer. Here equal values are
counted first and the counts cut into ranges; the sums of the ranges show which of them hold the wanted ranks, and only
those are put in order. Every table and group goes the same way, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import as_tuple
from chronoplane.operators.ranges import BEFORE, RANGE, before_ranges, in_ranges, with_ranges


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by=(), hot_rows: int | None = None) -> DataFrame:
    """One row per group: `by`, `n` and one column per entry of `probs`, interpolated linearly.

    Position (n - 1) p lies between two order statistics; the result is their weighted mean. NULL values are left out, and
    groups that have no others. `hot_rows` has no effect any more: no group is read whole.
    """
    by = list(as_tuple(by))
    held = df.filter(F.col(value).isNotNull()).withColumn("__x", F.col(value).cast("double"))
    counts = held.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__m"))
    rows = in_ranges(counts, [F.col(c) for c in [*by, "__x"]])
    per = before_ranges(rows, by, F.sum("__m"), "n")
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = {(name, side): f(x) for name, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    holds = reduce(lambda a, b: a | b, [(F.col(BEFORE) <= k) & (k < F.col(BEFORE) + F.col("__size")) for k in ranks.values()])
    few = with_ranges(rows, per.filter(holds).drop("__size"), by)
    inside = Window.partitionBy(*by, RANGE).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("__end", F.col(BEFORE) + F.sum("__m").over(inside))
    start = F.col("__end") - F.col("__m")
    aggs = [F.max(F.when((start <= k) & (k < F.col("__end")), F.col("__x"))).alias(f"__{side}_{name}") for (name, side), k in ranks.items()]
    aggs += [F.max(x - F.floor(x)).alias(f"__w_{name}") for name, x in at.items()]
    picked = few.groupBy(*by).agg(F.max("n").alias("n"), *aggs).where(F.col("n").isNotNull())
    cols = [
        (
            F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__w_{name}")
        ).alias(name)
        for name in probs
    ]
    return picked.select(*by, "n", *cols)


def exact_median(df: DataFrame, value: str, by=(), name: str = "median", hot_rows: int | None = 1_000_000) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, by, hot_rows).drop("n")


def medians(df: DataFrame, values, by=(), hot_rows: int | None = 1_000_000) -> DataFrame:
    """Exact medians of several columns in one pass: values are stacked as (column, value) rows first.

    Result rows: `by`, `column`, `n`, `median`.
    """
    by, values = list(as_tuple(by)), as_tuple(values)
    stacked = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        by, list(values), "column", "__v"
    )
    return exact_quantiles(stacked, "__v", {"median": 0.5}, [*by, "column"], hot_rows)
