"""A feature of a row depends on earlier rows of the same entity only."""

import pytest
from pyspark.sql import functions as F

from chronoplane.operators import history as H
from chronoplane.operators.master import entity_features
from conftest import column


def test_lagged_means_hand_values(sequential, keys):
    means = column(H.lag_roll_mean(sequential, keys, "pra"), "pra_mean_5")
    assert means[0] is None
    assert means[1:6] == [10.0, 15.0, 20.0, 25.0, 30.0]


def test_slope_and_gap_hand_values(sequential, keys):
    slopes = column(H.lag_trend(sequential, keys, "pra"), "pra_trend")
    assert slopes[:3] == [None] * 3
    assert slopes[3:] == pytest.approx([10.0] * 7)
    assert column(H.gap_days(sequential, keys), "days_since_last") == [None] + [2] * 9
    assert column(H.gap_flags(sequential, keys), "days_since_last")[0] == 3


def test_deviation_needs_two_values(sequential, keys):
    std = column(H.lag_roll_std(sequential, keys, "pra"), "pra_std_5")
    assert std[:2] == [None, None]
    assert std[2] == pytest.approx(7.0710678, abs=1e-6)


def test_entities_do_not_mix(several, keys):
    means = H.lag_roll_mean(several, keys, "pra")
    for p in (1, 2, 3):
        got = column(means.filter(F.col("player_id") == p), "pra_mean_5")
        assert got[0] is None and got[1] == 20 + 5 * p


def test_first_rows_have_no_features(several, keys):
    out = entity_features(several, keys, "pra", "pra", "minutes")
    first = out.filter(F.col("game_id") % 100 == 0).collect()
    for row in first:
        for name in ("pra_mean_5", "pra_std_20", "pra_trend", "pra_ewma_7", "minutes_last_game", "is_dnp_prev"):
            assert row[name] is None, name
        assert row["games_this_season"] == 0


@pytest.mark.parametrize("hot_rows", [1_000_000, 4])
def test_changing_a_row_changes_no_feature_up_to_it(sequential, keys, hot_rows):
    k = keys.with_(hot_rows=hot_rows)
    changed = sequential.withColumns(
        {c: F.when(F.col("game_id") == 105, F.lit(999.0)).otherwise(F.col(c)) for c in ("pra", "minutes")}
    )
    drop = ("pra", "minutes")
    a = {r["game_id"]: r for r in entity_features(sequential, k, "pra", "pra", "minutes").drop(*drop).collect()}
    b = {r["game_id"]: r for r in entity_features(changed, k, "pra", "pra", "minutes").drop(*drop).collect()}
    for g in range(100, 106):
        for name in a[g].asDict():
            assert a[g][name] == b[g][name], (g, name)
    assert a[106]["pra_mean_5"] != b[106]["pra_mean_5"]


def test_result_does_not_depend_on_input_order_or_partitions(several, keys):
    a = entity_features(several, keys, "pra", "pra", "minutes").orderBy("game_id").collect()
    shuffled = several.orderBy(F.xxhash64("game_id")).repartition(7)
    assert entity_features(shuffled, keys, "pra", "pra", "minutes").orderBy("game_id").collect() == a
