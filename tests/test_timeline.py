"""Histories cut into blocks give the same values as whole ones, also with ties, NULLs and one hot entity."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoplane.keys import Keys
from chronoplane.operators import absence as A
from chronoplane.operators import category as C
from chronoplane.operators import history as H
from chronoplane.operators.master import entity_features
from chronoplane.operators.timeline import number_rows
from conftest import day


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows; entity 1 and the NULL entity hold two thirds; days repeat; some values and one time are NULL."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        e = rnd.choice([1, 1, 1, None, 2, 3])
        d = day(rnd.randrange(400))
        v = None if rnd.random() < 0.2 else round(rnd.uniform(0, 40), 1)
        season = f"{d.year}"
        rows.append((e, i, d if i else None, season, v, rnd.choice("ab")))
    return spark.createDataFrame(rows, "e long, id long, d date, season string, v double, cat string")


WHOLE = Keys("e", "d", "id", season="season", hot_rows=None)


def same(a, b):
    x, y = (f.toPandas().sort_values("id").reset_index(drop=True) for f in (a, b))
    pd.testing.assert_frame_equal(x, y[x.columns], check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("hot_rows", [3, 25])
@pytest.mark.parametrize(
    "op",
    [
        lambda df, k: H.lag_roll(df, k, "v", (2, 5)),
        lambda df, k: H.lag_ewma(df, k, "v", (0.1, 0.3)),
        lambda df, k: H.lag_ewma(df, k, "v", (3, 7)),
        lambda df, k: H.lag_trend(df, k, "v", 4),
        lambda df, k: H.season_seq(df, k),
        lambda df, k: H.form_flags(df, k, "v"),
        lambda df, k: H.seasons_available(df, k, "v"),
        lambda df, k: A.events_since_reset(df, k, 3),
        lambda df, k: A.dnp_patterns(df, k, "v", rows=6),
        lambda df, k: A.dnp_patterns(df, k, "v", rows=6, lag=True),
        lambda df, k: A.recovery(df, k, "v"),
        lambda df, k: C.group_z(df, k, "cat", "v"),
        lambda df, k: entity_features(df, k, "v", "v", "v", F.col("cat") == "a", (3,), (1,)),
    ],
)
def test_cut_equals_whole(skewed, op, hot_rows):
    same(op(skewed, WHOLE), op(skewed, WHOLE.with_(hot_rows=hot_rows)))


def test_number_rows_is_exact_for_every_order_type(spark, skewed):
    by_value = skewed.filter(F.col("v").isNotNull()).withColumns(
        {"text": F.format_string("%08.3f", "v"), "both": F.struct("v", "id")}
    )
    for order in ("v", "text", "both", "d"):
        got = number_rows(by_value, Keys("e", order, "id")).orderBy("__k").collect()
        for e in (1, 2, 3, None):
            rows = [r for r in got if r["e"] == e]
            assert [r["__k"] for r in rows] == list(range(len(rows)))
            keyed = [(r[order] is not None, r[order], r["id"]) if r[order] is not None else (False, r["id"]) for r in rows]
            assert keyed == sorted(keyed, key=lambda x: (x[0], *x[1:]))


def test_cannot_order_by_an_array(skewed):
    with pytest.raises(TypeError):
        number_rows(skewed.withColumn("x", F.array("v")), Keys("e", "x", "id"))


@pytest.mark.parametrize("hot_rows", [None, 40])
def test_expanding_percentile_against_brute_force(skewed, hot_rows):
    out = C.expanding_percentile(skewed, WHOLE.with_(hot_rows=hot_rows), "cat", "v").toPandas()
    out["dk"] = pd.to_datetime(out["d"])
    for _, g in out.groupby("cat"):
        # Same order as Spark: NULL time first, then entity with NULL first, then id.
        g = g.sort_values(["dk", "e", "id"], na_position="first").reset_index(drop=True)
        for i, row in g.iterrows():
            past = g["v"][:i].dropna()
            if pd.isna(row["v"]) or past.empty:
                assert row["percentile"] == 50.0
            else:
                assert row["percentile"] == pytest.approx((past < row["v"]).mean() * 100)


def test_ewma_matches_data_frames(skewed):
    out = H.lag_ewma(skewed.filter(F.col("d").isNotNull()), WHOLE, "v", (2, 5)).toPandas()
    out = out[out["e"].notna()].sort_values(["e", "d", "id"])
    for h in (2, 5):
        want = out.groupby("e")["v"].transform(lambda s: s.shift(1).ewm(halflife=h, adjust=True, ignore_na=False).mean())
        pd.testing.assert_series_equal(out[f"v_ewma_{h}"], want, check_names=False, rtol=1e-9)


def test_ewma_of_a_long_history(spark):
    n = 7000
    df = spark.range(n).select(
        F.lit(1).alias("e"), F.col("id"), F.col("id").cast("int").alias("d"),
        F.when((F.col("id") < 200) | (F.col("id") > 3500), F.sin(F.col("id").cast("double"))).alias("v"),
    )
    out = H.lag_ewma(df, Keys("e", "d", "id"), "v", (3,)).toPandas().sort_values("id")
    want = out["v"].shift(1).ewm(halflife=3, adjust=True, ignore_na=False).mean()
    pd.testing.assert_series_equal(out["v_ewma_3"].reset_index(drop=True), want.reset_index(drop=True), check_names=False, atol=1e-9)
