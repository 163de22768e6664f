from chronoplane.operators import absence as A
from chronoplane.operators import history as H
from conftest import column


def test_run_of_played_rows(not_played, keys):
    out = A.dnp_patterns(not_played, keys, "minutes")
    assert column(out, "consecutive_played") == [1, 2, 0, 0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 0, 1]
    assert column(out, "is_dnp") == [int(i in (2, 3, 7, 13)) for i in range(15)]


def test_lagged_form_is_the_same_run_one_row_later(not_played, keys):
    out = A.dnp_patterns(not_played, keys, "minutes", lag=True)
    assert column(out, "consecutive_played_prev") == [None, 1, 2, 0, 0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 0]
    assert "is_dnp" not in out.columns


def test_counter_restarts_after_a_long_gap(spark, keys):
    from conftest import day

    days = [0, 2, 4, 20, 22, 24, 26, 28, 30, 60]
    df = spark.createDataFrame(
        [(1, i, day(d), "s") for i, d in enumerate(days)], "player_id long, game_id long, game_date date, season string"
    )
    out = A.events_since_reset(df, keys)
    assert column(out, "games_since_reset") == [0, 1, 2, 0, 1, 2, 3, 4, 5, 0]
    assert column(out, "is_early_return") == [0, 1, 1, 0, 1, 1, 0, 0, 0, 0]
    missed = A.missed_events(df, keys)
    assert column(missed, "likely_missed") == [0, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    assert column(missed, "estimated_missed")[3] == 6.5


def test_day_counts_exclude_the_day_itself(sequential, keys):
    out = H.count_last_days(sequential, keys, (7,))
    assert column(out, "games_last_7_days") == [0, 1, 2, 3, 3, 3, 3, 3, 3, 3]
    assert column(H.availability(sequential, keys), "availability_score")[6] == 50.0
