import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplane.keys import Keys
from chronoplane.operators.quantiles import exact_quantiles, medians
from chronoplane.operators.ranges import RANGE, in_ranges
from chronoplane.operators.timeline import number_rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_equal_to_linear_interpolation(spark, hot_rows):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(0, 100, 301)] + [("b", float(x)) for x in rng.integers(0, 5, 100)]
    rows += [("c", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for r in exact_quantiles(df, "x", probs, "g", hot_rows).collect():
        xs = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["n"] == len(xs)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(xs, p))
    whole = exact_quantiles(df, "x", probs, hot_rows=hot_rows).first()
    assert whole["q50"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_medians_of_several_columns(spark):
    df = spark.range(9).select((F.col("id") * 1.0).alias("x"), (F.col("id") * F.col("id")).alias("y"))
    got = {r["column"]: r["median"] for r in medians(df, ["x", "y"]).collect()}
    assert got == {"x": 4.0, "y": 16.0}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_quantiles_plan_few_exchanges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.sqrt("id").alias("x"))
    assert exchanges(exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.99})) < 10
    assert exchanges(exact_quantiles(df, "x", {"a": 0.1, "b": 0.5}, "g")) < 10


def test_quantiles_of_odd_groups(spark):
    """NULL groups, NaN and infinities, one value many times, and no rows."""
    rows = [(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", float("-inf")), ("b", 5.0), ("b", 6.0), ("d", None)]
    df = spark.createDataFrame(rows + [("c", 4.0)] * 500, "g string, x double")
    got = {r["g"]: (r["n"], r["m"]) for r in exact_quantiles(df, "x", {"m": 0.5}, "g").collect()}
    assert got == {None: (2, 2.0), "a": (3, 2.0), "b": (3, 5.0), "c": (500, 4.0)}
    assert exact_quantiles(df.limit(0), "x", {"m": 0.5}).count() == 0 == exact_quantiles(df.limit(0), "x", {"m": 0.5}, "g").count()


@pytest.mark.parametrize("order", ["text", "day", "nothing"])
def test_any_order_gives_many_ranges(spark, order):
    """Texts with one beginning, one day, and only NULL times are cut into ranges of bounded size by the tie-break."""
    df = spark.range(50_000).select(
        "id", F.concat(F.lit("the same beginning "), F.lpad(F.col("id").cast("string"), 8, "0")).alias("text"),
        F.lit("2024-01-01").cast("date").alias("day"), F.lit(None).cast("timestamp").alias("nothing"),
    )
    sizes = [r["count"] for r in in_ranges(df, [F.col(order), F.col("id")]).groupBy(RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 50_000 / 8
    got = number_rows(df, Keys((), order, "id"), "k", "total")
    assert got.where("k <> id OR total <> 50000").isEmpty() and got.count() == 50_000
