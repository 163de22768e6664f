"""Fitted baselines, fold ensembles, walk-forward runs and stored models on a table with a signal."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoplane.operators import models as M
from chronoplane.operators.transformers import OVERALL, CategoryBaselines, CategoryBaselinesModel, baseline_table, rolling_baselines

START = dt.date(2020, 1, 1)
FEATURES = ("x", "w_filled", "w_vs_group", "w_group_z")
SMALL = {"trees": 8, "depth": 3}


@pytest.fixture(scope="module")
def table(spark):
    """Outcome 10 x + category + noise; w is the outcome's lagged cousin and missing in a quarter of the rows."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        g = rng.choice("abc") if i % 50 else None
        x, w = rng.random(), None if rng.random() < 0.25 else rng.gauss({"a": 5, "b": 50}.get(g, 20), 3)
        y = 10 * x + {"a": 0, "b": 8}.get(g, 3) + rng.gauss(0, 0.5)
        rows.append((i, START + dt.timedelta(days=i), g, x, w, y))
    return spark.createDataFrame(rows, "id long, day date, g string, x double, w double, y double").cache()


def prepare(method="mean"):
    return CategoryBaselines(category="g", values=["w"], method=method)


def values(df, *order):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_validation_rows_fit_nothing(table):
    """Other validation rows change no baseline of any fold."""
    parts = M.contiguous_folds(table, "day", "id", 3).withColumn(M.HELD_OUT, F.col("split") == "val")
    other = parts.withColumns({"w": F.when(F.col(M.HELD_OUT), F.lit(1e6)).otherwise(F.col("w")), "g": F.when(F.col(M.HELD_OUT), F.lit("z")).otherwise(F.col("g"))})
    assert values(M.fold_baselines(parts, prepare())) == values(M.fold_baselines(other, prepare()))


def test_folds_fit_their_own_baselines(table):
    fitted = M.fit_folds(table, FEATURES, "y", "day", "id", 3, prepare(), **SMALL)
    parts = M.contiguous_folds(table, "day", "id", 3)
    for i, model in enumerate(fitted.models):
        mine = parts.filter((F.col("fold") == i) & (F.col("split") == "train"))
        want = baseline_table(mine, (), "g", ["w"])
        own = M.prepared_by(model).table
        key = lambda df: {(r["g"], r[OVERALL]): (round(r["w_mean"], 9), round(r["w_std"], 9), round(r["w_median"], 9), r["w_count"]) for r in df.collect()}
        assert key(own) == key(want)
    assert fitted.validation.count() == parts.filter("split = 'val'").count()
    assert {"prediction", *FEATURES} <= set(fitted.validation.columns)


def test_ensemble_beats_the_mean_and_variance_fits_its_errors(table):
    train, test = table.filter("id < 900"), table.filter("id >= 900")
    fitted = M.fit_folds(train, FEATURES, "y", "day", "id", 3, prepare(), **SMALL)
    scored = M.score_ensemble(fitted.models, test)
    assert scored.columns == [*test.columns, "prediction"]
    mean = train.agg(F.avg("y")).first()[0]
    error, base = scored.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), F.avg(F.pow(F.col("y") - mean, 2))).first()
    assert error < 0.25 * base
    model = M.fit_fold_variance(fitted, FEATURES, "y", **SMALL)
    whole = prepare().fit(train)
    spread = M.score_variance(model, M.score_ensemble(fitted.models, test, prepare=whole)).agg(F.avg("variance")).first()[0]
    assert error / 4 < spread < error * 4


def test_stage_fills_and_compares(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", None), (None, 7.0), ("c", None)], "g string, w double")
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "b", None), (4, "new", None), (5, None, None), (6, "c", None), (7, "b", 4.0)], "id int, g string, w double")
    got = {r["id"]: (r["w_filled"], r["w_vs_group"], r["w_group_z"]) for r in prepare().fit(train).transform(rows).collect()}
    overall = 21 / 4
    assert got == {
        1: (5.0, 3.0, pytest.approx(3 / 2**0.5)), 2: (2.0, 0.0, 0.0), 3: (10.0, 0.0, 0.0), 4: (overall, 0.0, 0.0),
        5: (7.0, 0.0, 0.0), 6: (overall, 0.0, 0.0), 7: (4.0, -6.0, 0.0),
    }
    empty = prepare("median").fit(train.limit(0)).transform(rows)
    assert {r["w_filled"] for r in empty.collect()} == {5.0, 4.0, 0.0}
    assert prepare().fit(train).transform(rows.limit(0)).count() == 0


def test_stored_models_and_a_changed_list(spark, table, tmp_path):
    models = M.fit_ensemble(table, FEATURES, "y", "day", "id", 2, prepare("median"), **SMALL)
    path = f"{tmp_path}/models"
    M.save_models(models, path)
    back = M.load_models(spark, path, FEATURES)
    assert [M.model_features(m) for m in back] == [list(FEATURES)] * 2
    assert isinstance(M.prepared_by(back[0]), CategoryBaselinesModel) and M.prepared_by(back[0]).names() == ("g", ["w"], "median")
    assert values(M.score_ensemble(models, table)) == values(M.score_ensemble(back, table))
    with pytest.raises(ValueError, match="reads"):
        M.load_models(spark, path, (*FEATURES, "z"))
    with pytest.raises(ValueError, match="reads"):
        M.load_models(spark, path, FEATURES[::-1])
    with pytest.raises(ValueError, match="missing columns"):
        M.score_ensemble(back, table.drop("x"))
    with pytest.raises(Exception):
        M.save_models(models, path)


def test_rolling_baselines(spark, table):
    dates = [START + dt.timedelta(days=d) for d in (0, 30, 400, 1199, 3000)]
    frame = spark.createDataFrame([(d,) for d in dates], "refit date")
    got = {(r["refit"], r["g"], r[OVERALL]): r for r in rolling_baselines(frame, "refit", table, "day", "g", ["w", "x"], 365).collect()}
    rows = pd.DataFrame([r.asDict() for r in table.collect()])
    want = {}
    for d in dates:
        part = rows[(rows.day >= d - dt.timedelta(days=365)) & (rows.day < d)]
        if len(part):
            want[d, None, True] = part
        for g, sub in part.groupby(part.g.fillna("none")):
            want[d, None if g == "none" else g, False] = sub
    assert set(got) == set(want)
    for key, part in want.items():
        r = got[key]
        assert r["train_rows"] == len(part)
        for v in ("w", "x"):
            assert r[f"{v}_count"] == part[v].count()
            for name, x in ((f"{v}_mean", part[v].mean()), (f"{v}_std", part[v].std())):
                assert (r[name] is None and pd.isna(x)) or r[name] == pytest.approx(x, rel=1e-9)


def test_walk_forward_sees_only_the_past(table):
    starts, until = [START + dt.timedelta(days=d) for d in (700, 900)], START + dt.timedelta(days=1100)
    run = lambda df: M.walk_forward(df, FEATURES, "y", "day", "id", starts, until, 2, 2, keep=("id",), prepare=prepare(), variance=True, **SMALL)
    got = {r["id"]: r for r in run(table).collect()}
    assert set(got) == set(range(700, 1100))
    mean = table.filter("id < 700").agg(F.avg("y")).first()[0]
    error = sum((r["y"] - r["prediction"]) ** 2 for r in got.values())
    assert error < 0.3 * sum((r["y"] - mean) ** 2 for r in got.values()) and all(r["variance"] > 0 for r in got.values())
    # Outcomes and values from the second refit on change no prediction before it.
    later = F.col("id") >= 900
    other = table.withColumns({"y": F.when(later, F.lit(500.0)).otherwise(F.col("y")), "w": F.when(later, F.lit(-9.0)).otherwise(F.col("w"))})
    again = {r["id"]: r["prediction"] for r in run(other).collect()}
    assert all(again[i] == got[i]["prediction"] for i in range(700, 900))


def test_small_windows_predict_nothing(table):
    starts, until = [START + dt.timedelta(days=d) for d in (40, 600)], START + dt.timedelta(days=700)
    got = M.walk_forward(table, ("x",), "y", "day", "id", starts, until, 1, 2, keep=("id",), least_rows=200, **SMALL)
    assert {r["id"] for r in got.collect()} == set(range(600, 700))
    with pytest.raises(ValueError, match="enough"):
        M.walk_forward(table, ("x",), "y", "day", "id", starts, until, 1, 2, least_rows=5000, **SMALL)
    with pytest.raises(ValueError, match="median"):
        M.walk_forward(table, FEATURES, "y", "day", "id", starts, until, prepare=prepare("median"))


def test_decisions_leave_out_the_calibrators_days(spark, table):
    pred = table.select("id", "day", "y", (F.col("y") + 0.3).alias("prediction"), F.lit(4.0).alias("variance"))
    lines = table.select("id", F.when(F.col("id") % 2 == 0, F.col("y") - 2).alias("line"))
    got = M.decide(pred, lines, "id", "day", "y", max_cv=5.0).collect()
    assert {r["id"] for r in got} == set(range(240, 1200, 2))
    assert all(r["bet_over"] and r["bet_correct"] and r["profit"] == pytest.approx(0.909) for r in got)
