import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoplane.functions import cleaning as K
from chronoplane.functions import odds as O
from chronoplane.functions import special as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_durations(spark):
    rows = [("32:30", 32.5), ("48", 48.0), (None, 0.0), ("DNP", 0.0), ("a:b", 0.0), ("0:00", 0.0)]
    df = spark.createDataFrame(rows, "m string, want double")
    for r in df.withColumn("got", K.parse_duration("m")).collect():
        assert r["got"] == r["want"]


def test_seasons(spark):
    df = spark.createDataFrame([("2023-10-01", "2023-24"), ("2024-09-30", "2023-24"), ("1999-12-31", "1999-00")], "d string, s string")
    for r in df.withColumn("got", K.season_label(F.to_date("d"))).withColumn("prev", K.season_lookup("s")).collect():
        assert r["got"] == r["s"]
        assert int(r["prev"][:4]) == int(r["s"][:4]) - 1
    assert one(spark, K.season_id_decode(F.lit("22024"))) == "2024-25"
    assert one(spark, K.season_lookup(F.lit("2000-01"))) == "1999-00"


def test_labels(spark):
    assert one(spark, K.opponent_of(F.lit("LAL @ BOS"))) == "BOS"
    assert one(spark, K.opponent_of(F.lit("LAL vs. NYK"))) == "NYK"
    assert one(spark, K.home_flag(F.lit("LAL vs. NYK"))) == 1
    assert one(spark, K.home_flag(F.lit("LAL @ NYK"))) == 0
    assert one(spark, K.team_of(F.lit("LAL @ NYK"))) == "LAL"


def test_safe_arithmetic(spark):
    assert one(spark, K.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, K.z_score(F.lit(3.0), F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, K.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, K.pct_to_fraction(F.lit("25.3%"))) == pytest.approx(0.253)


def test_odds_hand_values(spark):
    assert one(spark, O.american_to_probability(-110)) == pytest.approx(0.5238, abs=1e-4)
    assert one(spark, O.american_to_probability(100)) == 0.5
    assert one(spark, O.edge(F.lit(0.65))) == pytest.approx(0.1262, abs=1e-4)
    assert one(spark, O.kelly_uncapped(F.lit(0.65))) == pytest.approx(0.0663, abs=1e-4)
    assert one(spark, O.kelly_uncapped(F.lit(0.45))) == 0
    assert one(spark, O.kelly_size(F.lit(0.54))) == 0
    with pytest.raises(PySparkException):
        one(spark, O.american_to_probability(F.lit(0)))


def test_feature_selection_rejects_bad_values(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 2.0)], "id long, x double, s string, y double")
    assert K.select_features(df, "y", "id") == ["x"]
    with pytest.raises(ValueError):
        K.select_features(df, None, stored=["absent"])
    with pytest.raises(PySparkException):
        K.feature_matrix(df.withColumn("x", F.lit(float("inf"))), "y", ["x"]).collect()
    with pytest.raises(PySparkException):
        K.feature_matrix(df.withColumn("y", F.lit(None).cast("double")), "y", ["x"]).collect()


def test_gamma_functions():
    assert S.gamma_cdf_array(39.0625, 1.5625 * 23.5) == pytest.approx(0.371026, abs=1e-6)
    x = np.linspace(0.01, 30, 200)
    assert S.gamma_cdf_array(np.ones(200), x) == pytest.approx(1 - np.exp(-x), abs=1e-12)
    rng = np.random.default_rng(1)
    a, p = rng.uniform(0.1, 200, 500), rng.uniform(0.001, 0.999, 500)
    assert S.gamma_cdf_array(a, S.gamma_quantile_array(a, p)) == pytest.approx(p, abs=1e-11)


def test_tails():
    k, n, q = 60, 100, 0.524
    exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
    assert S.beta_cdf_array([k], [n - k + 1], [q])[0] == pytest.approx(exact, rel=1e-10)
    # One degree of freedom is the Cauchy distribution.
    assert S.beta_cdf_array([0.5], [0.5], [1 / (1 + 4.0)])[0] == pytest.approx(1 - 2 * math.atan(2) / math.pi, rel=1e-9)


def test_normal_quantile_in_the_tails():
    from chronoplane.functions.special import gamma_cdf_array, gamma_quantile_array, normal_quantile_array, t_quantile_array

    got = normal_quantile_array(np.array([1e-20, 1e-300, 0.025, 0.5, 1 - 1e-10, 0.0, 1.0]))
    assert np.allclose(got, [-9.262340089798408, -37.047096499407115, -1.9599639845400545, 0.0, 6.361340902404056, -np.inf, np.inf], rtol=1e-7)
    shapes, levels = np.meshgrid([0.1, 0.5, 1.0, 3.7, 50.0, 1e4], [1e-6, 0.01, 0.5, 0.99, 1 - 1e-9])
    x = gamma_quantile_array(shapes, levels)
    assert np.allclose(gamma_cdf_array(shapes.ravel(), x.ravel()), levels.ravel(), atol=1e-11)
    assert np.allclose(t_quantile_array(np.array([0.975, 0.025, 0.9]), np.array([5.0, 5.0, 1.0])), [2.5705818366147395, -2.5705818366147395, 3.077683537175253])
