"""Ties, narrow ranges, empty and one-sided tables, corrections: cases at the edges of the operators."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplane.functions import special
from chronoplane.functions.cleaning import to_date_coerce
from chronoplane.keys import Keys
from chronoplane.operators import category, joins, ledger, performance, profile, quantiles, timeline
from chronoplane.session import work_path
from chronoplane.sources import readers
from chronoplane.streaming.ingest import event_stream, stream_ingest
from chronoplane.streaming.settle import settled_bets, stream_ledger

EVENTS = Keys("who", "at", "event")


def test_as_of_takes_the_latest_of_same_time_facts_by_typed_order(spark):
    facts = spark.createDataFrame([(1, 5, 9, 1.0), (1, 5, 10, 2.0), (1, 4, 99, 3.0)], "who int, at int, event long, v double")
    targets = spark.createDataFrame([(1, 6), (1, 5), (1, 4)], "who int, at int")
    got = {r["at"]: r["v"] for r in joins.asof_join(targets, facts, EVENTS, "v").collect()}
    assert got == {6: 2.0, 5: 3.0, 4: None}
    assert joins.asof_latest(facts, EVENTS, "v", 6).first()["v"] == 2.0


@pytest.mark.parametrize("base", [0.0, 1e6, 1e9, -3e9])
def test_running_deviation_far_from_zero(spark, base):
    values = [base + d for d in (0.0, 1.0, 0.0, 2.0, 1.0, 5.0)]
    df = spark.createDataFrame([("c", i, i, v) for i, v in enumerate(values)], "g string, at int, event int, v double")
    for hot in (1_000_000, 2):
        got = sorted((r["at"], r["v_prior_std"]) for r in category.running_moments(df, Keys("g", "at", "event", hot_rows=hot), "v").collect())
        for at, std in got[2:]:
            assert std == pytest.approx(np.std(values[:at], ddof=1), rel=1e-6)


def test_range_join_deviation_far_from_zero(spark):
    facts = spark.createDataFrame([("2024-01-01", 1e9), ("2024-01-02", 1e9 + 1), ("2024-01-03", 1e9 + 3)], "d string, v double").withColumn("d", F.to_date("d"))
    dates = spark.createDataFrame([("2024-02-01",), ("2023-01-01",)], "d string").withColumn("d", F.to_date("d"))
    got = {str(r["d"]): r for r in joins.window_range_join(dates, "d", facts, "d", "v").collect()}
    assert got["2024-02-01"]["train_std"] == pytest.approx(np.std([0, 1, 3], ddof=1)) and got["2024-02-01"]["train_mean"] == pytest.approx(1e9 + 4 / 3)
    assert got["2023-01-01"]["train_rows"] == 0 and got["2023-01-01"]["train_std"] is None


@pytest.mark.parametrize("hot", [5, 1_000_000])
def test_quantiles_of_numbers_at_the_ends(spark, hot):
    rows = [(float(i),) for i in range(20)]
    df = spark.createDataFrame(rows + [(float("nan"),), (float("-inf"),), (float("inf"),)], "v double")
    got = quantiles.exact_quantiles(df, "v", {"m": 0.5, "low": 0.0}, hot_rows=hot).first()
    assert (got["n"], got["m"]) == (23, 10.0)
    assert quantiles.exact_quantiles(df.where("v > 1e9 and v < 2e9"), "v", {"m": 0.5}, hot_rows=hot).count() == 0


def test_ungrouped_quantiles_need_no_cross_join(spark):
    df = spark.range(1000).select((F.col("id") / 7).alias("v"))
    plan = quantiles.exact_quantiles(df, "v", {"m": 0.5}, hot_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and all("(" in line or "=" in line for line in plan.splitlines() if "Join Inner" in line)


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (25.0, 30.0), (-1e-3, 1e-3), (1e9, 1.001e9)])
def test_narrow_ranges_fall_into_many_slices(spark, low, high):
    df = spark.range(5000).select((F.lit(low) + F.col("id") / 5000 * (high - low)).alias("v"))
    keys = Keys((), "v", ())
    sizes = df.withColumn("s", timeline.slice_number(df, keys)).groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("s").collect()
    assert len(sizes) >= 5
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))


def test_dates_as_the_files_have_them(spark):
    texts = ["Oct 4, 2023", "Oct 14, 2023", "1/5/2024", "01/15/2024", "2024-02-03", "2024-02-03T10:00:00", "no date", None]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_date_coerce("t")).collect()]
    assert got == ["2023-10-04", "2023-10-14", "2024-01-05", "2024-01-15", "2024-02-03", "2024-02-03", "None", "None"]


def test_season_of_a_file(spark):
    base = work_path(spark, "export_2024-01")
    for name, header, row in (("games_2019-20", "PLAYER,V", "a,1"), ("x_2010-11", "PLAYER,SEASON_ID", "b,22024"), ("y_2011-12", "PLAYER,GAME_DATE", '"c, d","Nov 3, 2021"'), ("no season", "PLAYER,player", "e,f")):
        spark.createDataFrame([(f"{header}\n{row}",)], "value string").coalesce(1).write.text(f"{base}/{name}")
    got = {r["PLAYER"]: r["SEASON"] for r in readers.scan_csv_multi(spark, f"{base}/*/*.txt").collect()}
    assert got == {"a": "2019-20", "b": "2024-25", "c, d": "2021-22", "e": "2024-01"}


def test_large_arguments_of_the_distribution_functions():
    one = lambda f, *a: float(f(*[np.array([x], float) for x in a])[0])
    for n in (1e3, 1e6, 1e9):
        assert one(special.beta_cdf_array, n / 2, n / 2, 0.5) == pytest.approx(0.5, abs=1e-9)
    # The median of a Gamma with large shape a is a - 1/3 + 8 / (405 a).
    for a in (1e4, 9.99e4, 1e5, 1e6, 1e9, 1e12):
        assert one(special.gamma_cdf_array, a, a - 1 / 3 + 8 / (405 * a)) == pytest.approx(0.5, abs=1e-9)
    assert one(special.gamma_cdf_array, 1e6, 1e6 + 1e3) == pytest.approx(0.841355, abs=2e-4)
    assert one(special.t_quantile_array, 0.99999, 1) == pytest.approx(31830.988, rel=1e-6)
    assert one(special.t_quantile_array, 0.025, 10) == pytest.approx(-2.2281389, rel=1e-6)
    assert one(special.t_quantile_array, 1.0, 3) == np.inf


def test_summaries_of_one_sided_and_empty_tables(spark):
    schema = "bet_date date, bet_correct boolean, has_line boolean, profit double"
    days = spark.sql("SELECT date_add(date'2024-01-01', CAST(id AS INT)) AS bet_date, true AS bet_correct, true AS has_line, 0.9D AS profit FROM range(9)")
    totals = performance.daily_totals(days, "bet_date")
    assert {r["win_rate"] for r in performance.period_thirds(totals).collect()} == {1.0}
    empty = spark.createDataFrame([], schema)
    assert performance.period_thirds(performance.daily_totals(empty, "bet_date")).count() == 0
    assert performance.significance(empty, t_test=False).first()["win_rate"] is None
    events = spark.createDataFrame([], "who int, at date, event int, v double")
    assert profile.conditional_means(events, EVENTS, "v", F.col("v") > 0).first()["zero_share"] is None


def test_results_before_bets_and_corrections_settle_by_themselves(spark):
    path, settled, arrivals, ckpt = (work_path(spark, x) for x in ("ledger", "settled", "results", "ckpt"))
    bet = lambda name: spark.sql(f"SELECT '{name}' AS player_name, date'2024-01-05' AS bet_date, 20.0D AS betting_line, 'OVER' AS direction, 0.1D AS kelly_size, 0.05D AS edge")
    stamp = F.lit("2024-01-01").cast("timestamp")
    schema = "player_name string, bet_date date, actual double, version int"
    day = dt.date(2024, 1, 5)

    def run(bets=(), results=()):
        for name in bets:
            ledger.ledger_append(bet(name), path, F.col("bet_date"), stamp)
        if results:
            spark.createDataFrame([(n, day, v, k) for n, v, k in results], schema).coalesce(1).write.mode("append").parquet(arrivals)
        stream = event_stream(spark, arrivals, spark.read.parquet(arrivals).schema)
        q = stream_ledger(stream, path, settled, ckpt, newest="version")
        q.processAllAvailable()
        q.stop()
        return sorted((r["player_name"], r["status"], r["actual"]) for r in settled_bets(spark, settled).collect())

    # Two versions at once; "b" has a result and no bet yet.
    assert run(["a", "a"], [("a", 30.0, 1), ("a", 10.0, 2), ("b", 25.0, 1)]) == [("a", "lost", 10.0)] * 2
    assert run(["b"]) == [("a", "lost", 10.0)] * 2 + [("b", "won", 25.0)]
    # A correction, one that comes late, and one that comes twice.
    assert run([], [("b", 5.0, 3), ("b", 40.0, 2), ("a", 10.0, 2), ("a", 21.0, 4)]) == [("a", "won", 21.0)] * 2 + [("b", "lost", 5.0)]
    # A bet after both corrections; a result that is taken back leaves its bets pending.
    assert run(["b"], [("a", None, 5)]) == [("a", "pending", None)] * 2 + [("b", "lost", 5.0)] * 2


def test_workers_have_the_package_from_any_folder(tmp_path):
    code = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["gamma_tail"](spark, "/root/testdata/sf0.001").count())
print("sum", entry.queries()["gamma_tail"](spark, "/root/testdata/sf0.001").toPandas().shape[0])
"""
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, entry], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "sum " in out.stdout, out.stderr[-2000:]


def test_late_rows_are_kept_once(spark):
    src, out, ckpt = (work_path(spark, x) for x in ("arrivals", "ingested", "ckpt"))
    first = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-06-01'), (2, timestamp'2024-06-02'), (2, timestamp'2024-06-02'), (NULL, NULL) AS t(id, ts)")
    first.coalesce(1).write.parquet(src)
    later = spark.sql("SELECT * FROM VALUES (3, timestamp'2020-01-01'), (1, timestamp'2024-06-01'), (NULL, timestamp'2024-06-01') AS t(id, ts)")
    for rows in (None, later, None):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(src)
        q = stream_ingest(event_stream(spark, src, first.schema), out, ckpt, "id")
        q.processAllAvailable()
        q.stop()
    assert sorted((r["id"] for r in spark.read.parquet(out).collect()), key=str) == [1, 2, 3, None]
    # The second batch read its own three rows and looked up their keys; the first one's rows were not read again.
    batch = spark.read.parquet(out).groupBy("batch").count().collect()
    assert sorted(map(tuple, batch)) == [(0, 3), (1, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def moments_of(spark, rows, groups="g"):
    df = spark.createDataFrame(rows, "g string, at int, event int, v double").repartition(3)
    return {r["event"]: r for r in category.running_moments(df, Keys(groups, "at", "event"), "v").collect()}


@pytest.mark.parametrize("groups", ["g", None])
def test_running_moments_against_brute_force(spark, groups):
    rng = np.random.default_rng(5)
    rows = [(["hot", "hot", "hot", "b", None][i % 5], int(rng.integers(0, 9)), i, None if i % 7 == 0 else 1e7 + float(rng.normal())) for i in range(600)]
    got = moments_of(spark, rows, groups)
    assert len(got) == 600
    for g, at, event, _ in rows:
        seen = [v for h, t, e, v in rows if (groups is None or h == g) and (t, e) < (at, event) and v is not None]
        r = got[event]
        assert r["v_prior_n"] == len(seen)
        assert r["v_prior_mean"] == (pytest.approx(np.mean(seen), rel=1e-12) if seen else None)
        assert r["v_prior_std"] == (pytest.approx(np.std(seen, ddof=1), rel=1e-6) if len(seen) > 1 else None)


def test_running_moments_of_equal_and_endless_values(spark):
    got = moments_of(spark, [("level", i, i, 0.1) for i in range(200)] + [("end", i, 1000 + i, float("inf") if i == 50 else float(i)) for i in range(100)])
    assert {got[i]["v_prior_std"] for i in range(2, 200)} == {0.0}
    assert got[1050]["v_prior_mean"] == pytest.approx(24.5) and got[1099]["v_prior_mean"] == float("inf") and np.isnan(got[1099]["v_prior_std"])
    assert moments_of(spark, []) == {}


def test_moments_need_few_exchanges(spark):
    df = spark.range(500).selectExpr("'one' AS g", "id AS at", "id AS event", "cast(id AS double) AS v", "id % 9 AS who")
    plan = category.group_z(df, Keys("who", "at", "event"), "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") < 20


def test_earlier_and_smaller_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 64, 65, 200):
        at, by = rng.permutation(n), rng.permutation(n)
        want = [sum(1 for j in range(n) if at[j] < at[i] and by[j] < by[i]) for i in range(n)]
        assert category.earlier_and_smaller(at, (by // 7, by)).tolist() == want


def test_expanding_percentile_of_one_frequent_value_and_large_ids(spark):
    rows = [(2**62 + i if i % 3 else None, i % 11, i, [0.0, -0.0, 5.0, float("nan"), None][i % 5], "c" if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "who long, at int, event int, v double, cat string").repartition(4)
    got = {r["event"]: r["percentile"] for r in category.expanding_percentile(df, EVENTS, "cat", "v").collect()}
    place = lambda r: (r[1], r[0] is not None, r[0] or 0, r[2])
    high = lambda v: (v != v, v if v == v else 0.0)
    assert len(got) == 400
    for r in rows:
        past = [p[3] for p in rows if p[4] is not None and p[3] is not None and place(p) < place(r)]
        if r[3] is None or r[4] is None or not past:
            assert got[r[2]] == 50.0
        else:
            assert got[r[2]] == pytest.approx(100 * sum(high(p) < high(r[3]) for p in past) / len(past))
    assert category.expanding_percentile(df.limit(0), EVENTS, "cat", "v").count() == 0
