"""Joins, splits, imputation, quality, sources, decisions and ledger on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoplane.keys import Keys, require_columns, require_rows
from chronoplane.operators import decisions as D
from chronoplane.operators import imputation as I
from chronoplane.operators import joins as J
from chronoplane.operators import ledger as L
from chronoplane.operators import performance as PF
from chronoplane.operators import probability as PR
from chronoplane.operators import quality as Q
from chronoplane.operators import splits as S
from chronoplane.session import work_path
from chronoplane.sources import nested as N
from chronoplane.sources import readers as RD
from conftest import column, day


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "player_id long, game_id long, game_date date, pra double")
    with pytest.raises(ValueError):
        require_rows(empty)
    with pytest.raises(ValueError):
        require_columns(empty, ["absent"])


def test_join_master_keeps_rows_and_rejects_duplicates(sequential, keys):
    side = sequential.select(*keys.grain, (F.col("pra") * 2).alias("double_pra"))
    out = J.join_master(sequential, [side, side], keys.grain)
    assert out.count() == 10 and out.columns.count("double_pra") == 1
    with pytest.raises(PySparkException):
        J.join_master(sequential, [side.union(side)], keys.grain).collect()


def test_dedup_keeps_most_minutes(spark):
    df = spark.createDataFrame(
        [("a", "s1", 10.0, 1), ("a", "s1", 30.0, 2), ("b", "s1", 5.0, 3)], "name string, season string, min double, x int"
    )
    got = {r["name"]: r["x"] for r in J.dedup_max(df, ["name", "season"], "min").collect()}
    assert got == {"a": 2, "b": 3}


def test_previous_season_join_sees_no_same_season(spark):
    facts = spark.createDataFrame([("a", "2023-24"), ("a", "2022-23")], "name string, season string")
    ref = spark.createDataFrame([("a", "2022-23", 0.2, 9.0), ("a", "2023-24", 0.9, 9.0)], "name string, season string, usage double, min double")
    got = {r["season"]: r["prev_usage"] for r in J.join_prev_season(facts, ref, "name", "season", "min").collect()}
    assert got == {"2023-24": 0.2, "2022-23": None}


def test_asof_takes_latest_non_null_per_column(spark):
    facts = spark.createDataFrame(
        [(1, 1, day(0), 1.0, 5.0), (1, 2, day(2), None, 6.0), (1, 3, day(4), 9.0, 9.0)],
        "player_id long, game_id long, game_date date, a double, b double",
    )
    k = Keys("player_id", "game_date", "game_id")
    row = J.asof_latest(facts, k, ["a", "b"], F.lit(day(4))).first()
    assert (row["a"], row["b"]) == (1.0, 6.0)
    targets = spark.createDataFrame([(1, day(4), "x"), (1, day(5), "y"), (2, day(5), "z")], "player_id long, game_date date, t string")
    for hot in (None, 2):
        got = {r["t"]: (r["a"], r["b"]) for r in J.asof_join(targets, facts, k.with_(hot_rows=hot), ["a", "b"]).collect()}
        assert got == {"x": (1.0, 6.0), "y": (9.0, 9.0), "z": (None, None)}


def test_preferred_source(spark):
    df = spark.createDataFrame(
        [("a", "DraftKings", 1), ("a", "FanDuel", 2), ("b", "draftkings", 3), ("c", "other", 4)], "p string, bookmaker string, x int"
    )
    got = {r["p"]: r["x"] for r in J.pick_preferred(df, "p", "bookmaker", ["fanduel", "draftkings"], ["x"]).collect()}
    assert got == {"a": 2, "b": 3}


def test_season_folds_do_not_overlap_in_time(spark):
    rows = [
        (p, 1000 * p + i, dt.date(2015 + s, 11, 1) + dt.timedelta(days=i), f"{2015 + s}-{16 + s}")
        for p in range(3) for s in range(6) for i in range(20)
    ]
    df = spark.createDataFrame(rows, "player_id long, game_id long, game_date date, season string").withColumn("game_id", F.monotonically_increasing_id())
    k = Keys("player_id", "game_date", "game_id", season="season")
    out = S.season_cv(df, k, seasons=3, gap=15, min_test=10).cache()
    assert sorted(r["fold"] for r in out.select("fold").distinct().collect()) == [0, 1, 2]
    for r in S.split_bounds(out, "game_date", by=["fold"]).collect():
        want = {"train": 144, "val": 36, "test": 15}[r["split"]]
        assert r["rows"] == want
        assert r["overlaps"] is False or r["split"] == "val"


def test_imputation_reads_training_rows_only(spark):
    train = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", 8.0), ("h", None)], "position string, x double")
    test = spark.createDataFrame([("g", None), ("h", None), ("g", 100.0)], "position string, x double")
    assert sorted(r["x"] for r in I.impute_fit_apply(train, test, "x").collect()) == [3.0, 3.0, 100.0]
    b = I.group_baselines(train, "position", "x")
    mean = [r["x"] for r in I.impute_by_group(test, b, "position", "x").orderBy("position", "x").collect()]
    assert mean == [4.0, 100.0, None]
    z = I.group_relative(test, b, "position", "x").filter("x = 100").first()
    assert z["x_vs_group"] == 96.0


def test_quality_findings(spark):
    df = spark.createDataFrame([(1, 1, 5.0, None), (1, 1, -1.0, None), (2, 2, 7.0, 1.0)], "p long, g long, x double, y double")
    assert Q.check_grain(df, ["p", "g"]).collect()[0]["n"] == 2
    nulls = {r["column"]: (r["n_null"], r["level"]) for r in Q.null_profile(df).collect()}
    assert nulls["y"] == (2, "ERROR") and nulls["x"] == (0, "INFO")
    ranges = {r["column"]: r["in_range"] for r in Q.check_range(df, {"x": (0, 10), "y": (0, 1)}).collect()}
    assert ranges == {"x": False, "y": True}
    values = {r["check"]: r["n"] for r in Q.check_values(df, ["x"], key=["p", "g"]).collect()}
    assert values == {"negative:x": 1, "duplicate:p,g": 1}


PAYLOAD = {
    "id": "e1",
    "bookmakers": [
        {
            "key": "fd",
            "markets": [
                {"key": m, "outcomes": [{"name": "Over", "description": "A B", "price": -110, "point": p}, {"name": "Over", "price": -1, "point": 1.0}]}
                for m, p in (("player_points", 25.5), ("player_rebounds", 7.5), ("player_assists", 6.5))
            ],
        }
    ],
}


def test_nested_payload_to_one_line(spark):
    df = spark.createDataFrame([(json.dumps(PAYLOAD),)], "payload string")
    flat = N.flatten_nested(df, "payload")
    assert flat.count() == 3
    row = N.pivot_lines(flat, ["line"]).first()
    assert row["total_line"] == 39.5 and row["total_odds"] == -110


def test_incremental_ingest_keeps_latest(spark):
    schema = "player_id long, game_id long, game_date date, x int"
    stored = spark.createDataFrame([(1, 1, day(0), 1), (1, 2, day(2), 2)], schema)
    new = spark.createDataFrame([(1, 2, day(2), 99), (1, 3, day(4), 3), (1, 3, day(4), 4), (1, 1, day(5), 5)], schema)
    out = RD.incremental_ingest(stored, new, ["player_id", "game_id"], "game_date", ["game_date", "x"])
    assert {r["game_id"]: r["x"] for r in out.collect()} == {1: 5, 2: 2, 3: 4}


def test_absent_files(spark):
    path = work_path(spark, "absent")
    assert RD.scan_parquet(spark, path, missing_ok=True) is None
    assert RD.scan_odds(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        RD.scan_csv_multi(spark, path + "/*.csv")


def test_outcomes_of_missing_and_equal_lines(spark):
    df = spark.createDataFrame([(1, 30.0, 25.5, 28.0), (2, 25.0, 25.0, 26.0), (3, 20.0, None, 22.0)], "id long, actual double, line double, prediction double")
    out = D.bet_outcome(D.bet_decision_point(df, "prediction", "line"), "actual", "line")
    assert column(out, "bet_correct", "id") == [True, False, True]
    assert column(out, "profit", "id") == [0.909, -1.0, 0.0]


def test_better_side_and_tie_to_under(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 0.3, 0.2), (2, 0.05, -0.1, 0.4), (3, 0.9, 0.2, 0.2), (4, 0.5, 0.0, 0.0)],
        "id long, prob_over double, edge_over double, edge_under double",
    ).withColumns({"std": F.lit(3.0), "mean": F.lit(20.0), "confidence_score": F.lit(0.8)})
    out = D.bet_decision_best(df, "prob_over", "std", "mean")
    assert {r["id"]: r["direction"] for r in out.collect()} == {1: "OVER", 2: "UNDER", 3: "UNDER"}


def test_ledger_return(spark):
    bets = spark.createDataFrame(
        [("a", 25.5, "OVER", 0.1, 0.05), ("b", 30.5, "OVER", 0.1, 0.05), ("c", 1.5, "UNDER", 0.1, 0.05)],
        "player_name string, betting_line double, direction string, kelly_size double, edge double",
    )
    ledger = L.ledger_entries(bets, F.lit(day(0)))
    results = spark.createDataFrame([("a", day(0), 30.0), ("b", day(0), 25.0)], "player_name string, bet_date date, actual double")
    summary = L.ledger_summary(L.ledger_settle(ledger, results)).first()
    assert summary["roi"] == pytest.approx(-4.5)
    assert (summary["wins"], summary["losses"], summary["pending_bets"]) == (1, 1, 1)
    none = L.ledger_summary(ledger).first()
    assert none["win_rate"] is None and none["roi"] is None


def test_gamma_fit_and_sharpness(spark):
    df = spark.createDataFrame([(25.0, 16.0)], "m double, v double")
    fit = PR.gamma_fit(df, "m", "v")
    row = fit.first()
    assert row["alpha"] / row["beta"] == pytest.approx(25) and row["alpha"] / row["beta"] ** 2 == pytest.approx(16)
    width = PR.sharpness(fit, (0.9,)).first()["mean_width"]
    pair = PR.interval(fit, 0.9).first()
    assert width == pytest.approx(pair["upper"] - pair["lower"])
    # Bisection on the distribution function as the second opinion.
    from chronoplane.functions.special import gamma_cdf_array

    for p, got in ((0.05, pair["lower"]), (0.95, pair["upper"])):
        lo, hi = 0.0, 200.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if gamma_cdf_array(row["alpha"], row["beta"] * mid) < p else (lo, mid)
        assert got == pytest.approx(lo, rel=1e-9)
    with pytest.raises(PySparkException):
        PR.gamma_fit(df.withColumn("v", F.lit(0.0)), "m", "v", strict=True).collect()


def test_equity_compounds_like_a_loop(spark):
    rows = [(1, i, day(i), 0.1, i % 3 != 0) for i in range(12)]
    df = spark.createDataFrame(rows, "s long, id long, d date, f double, won boolean")
    bank, want = 1000.0, []
    for r in rows:
        bank += bank * r[3] * (100 / 110 if r[4] else -1)
        want.append(bank)
    for hot in (None, 5):
        got = PF.equity_curve(df, Keys("s", "d", "id", hot_rows=hot), "f", F.col("won"))
        assert column(got, "bankroll", "id") == pytest.approx(want)


def test_streams_keep_state_without_counting_its_keys(spark):
    from chronoplane.streaming.ingest import large_state

    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(name, None)
    with large_state(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before
