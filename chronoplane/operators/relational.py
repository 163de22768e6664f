"""Small set and ordering operators with the semantics the pipelines rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.timeline import Running, on_timeline


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack tables by name; a column a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def intersect_except(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys with the side they occur on: both, left or right."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def distinct_values(df: DataFrame, column: str, between: tuple | None = None) -> DataFrame:
    """Distinct values in order, optionally inside a closed interval."""
    if between:
        low, high = between
        if low is not None:
            df = df.filter(F.col(column) >= F.lit(low))
        if high is not None:
            df = df.filter(F.col(column) <= F.lit(high))
    return df.select(column).distinct().orderBy(column)


def first_per_group(df: DataFrame, keys: Keys, by=()) -> DataFrame:
    """First row of every entity (or entity and further columns), as a map-side aggregate."""
    part = [*keys.entity, *as_tuple(by)]
    order = [keys.time, *keys.event]
    rest = [c for c in df.columns if c not in part and c not in order]
    first = F.min(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("__f")
    return df.groupBy(*part).agg(first).select(*part, "__f.*").select(*df.columns)


def top_k(df: DataFrame, by, n: int) -> DataFrame:
    """First n rows; `by` are sort columns. Spark keeps n rows per task and merges them."""
    return df.orderBy(*by).limit(n)


def topk_edge(bets: DataFrame, n: int, edge: str = "edge", tie=()) -> DataFrame:
    """The n bets with the largest edge."""
    return top_k(bets, [F.col(edge).desc(), *[F.col(c) for c in as_tuple(tie)]], n)


def top_bottom_roi(stats: DataFrame, n: int = 10, roi: str = "roi", tie=()) -> DataFrame:
    """The n best and the n worst rows by return."""
    ties = [F.col(c) for c in as_tuple(tie)]
    best = top_k(stats, [F.col(roi).desc(), *ties], n).withColumn("side", F.lit("top"))
    worst = top_k(stats, [F.col(roi).asc(), *ties], n).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def sort_check(df: DataFrame, keys: Keys, sequence: str) -> DataFrame:
    """Per entity: rows whose time is before the time of an earlier row in ingest order.

    Row order has no meaning in a distributed table, so the order to check is an explicit sequence column.
    """
    by_sequence = keys.with_(time=sequence, event=())
    seen = on_timeline(df, by_sequence, lambda t: t.running({"__max": Running("max", F.col(keys.time))}))
    late = F.coalesce(F.col("__max") > F.col(keys.time), F.lit(False))
    return seen.groupBy(*keys.entity).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("out_of_order")
    )


def residual_table(df: DataFrame, actual: str, predicted: str, keep=()) -> DataFrame:
    """Row-level residual and absolute error."""
    r: Column = F.col(actual) - F.col(predicted)
    return df.select(
        *as_tuple(keep),
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        r.alias("residual"),
        F.abs(r).alias("abs_error"),
    )
