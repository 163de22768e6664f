"""Queries of the model operators: lagged features of the orders, trees of `pyspark.ml`.

SQL can't fit trees. It gives the rows that a model must score, whether predictions lie within the outcomes that the
model has seen, and all that is not a tree: folds' and windows' baselines, features, decisions. Errors against those of
the mean are one query, tests on a table with a signal another check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.functions.cleaning import player_filter
from chronoplane.operators import history as H
from chronoplane.operators import models as M
from chronoplane.operators import probability as PR
from chronoplane.operators.decisions import bet_decision_prob
from chronoplane.operators.joins import asof_latest, join_multi_line, pick_preferred
from chronoplane.operators.performance import edge_tiers
from chronoplane.operators.splits import contiguous_folds
from chronoplane.operators.timeline import on_timeline
from chronoplane.operators.transformers import CategoryBaselines, OVERALL
from chronoplane.plans.bindings import BREAK_EVEN, O_SQL, S_SQL, CUST_W, gamma_cdf_sql, order_keys, orders, predictions, rows
from chronoplane.plans.registry import n, query, r
from chronoplane.session import stored, work_path

FEATURES = ("v_mean_5", "v_mean_10", "v_std_5", "games_this_season", "month")
SMALL = {"trees": 8, "depth": 3}
#: Values that are filled and compared by category in each fold; both are missing early in a history.
VALUES = ("v_mean_10", "v_std_10")
PREPARED = (*FEATURES, *[f"{v}_{kind}" for v in VALUES for kind in ("filled", "vs_group", "group_z")])


def prepare() -> CategoryBaselines:
    return CategoryBaselines(category="o_orderpriority", values=list(VALUES))


def matrix(t):
    """Features known before the order, and its value; computed once, as the fits read it many times."""
    k = order_keys(t)
    rolled = H.season_seq(H.lag_roll(orders(t), k, "v", (5, 10)), k)
    rows = rolled.withColumn("month", F.month("o_orderdate")).filter(F.col("v_mean_5").isNotNull())
    # Two values keep their gaps, for the baselines to fill.
    held = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES if c not in VALUES})
    return stored(held.select("o_orderkey", "o_custkey", "o_orderdate", "season", "v", "o_orderpriority", *dict.fromkeys([*FEATURES, *VALUES])))


def before(df, day):
    return df.filter(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz"))


def since(df, day):
    return df.filter(F.col("o_orderdate") >= F.lit(day).cast("timestamp_ntz"))


def seen(train, *cols):
    """Whether predictions are within the outcomes of the training rows."""
    bounds = train.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("b")).scalar()
    return [F.col(c).between(bounds["low"] - 1e-6, bounds["high"] + 1e-6).alias(f"{c}_seen") for c in cols]


_M_SQL = O_SQL + f""",
m AS (SELECT * FROM (SELECT *, avg(v) OVER ({CUST_W} {rows(5)}) AS v_mean_5, avg(v) OVER ({CUST_W} {rows(10)}) AS v_mean_10 FROM o) WHERE v_mean_5 IS NOT NULL)"""
_TEST = "o_orderdate >= TIMESTAMP '1999-01-01'"


@query("fit_gbt", f"WITH {_M_SQL} SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-06-01' AS held, true AS prediction_seen FROM m WHERE NOT {_TEST}")
def fit_gbt(t):
    m = matrix(t)
    train = before(m, "1999-01-01").withColumn("held", F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    model = M.fit_gbt(train, FEATURES, "v", "held", **SMALL)
    return M.score_model(model, train).select("o_orderkey", "held", *seen(train, "prediction"))


@query("score_model", f"WITH {_M_SQL} SELECT o_orderkey, {r('v', 'v')}, true AS prediction_seen FROM m WHERE {_TEST}")
def score_model(t):
    """By a model that was stored and read back."""
    m = matrix(t)
    train, path = before(m, "1999-01-01"), work_path(t.spark, "model")
    M.save_models([M.fit_gbt(train, FEATURES, "v", **SMALL)], path)
    (model,) = M.load_models(t.spark, path, FEATURES)
    return M.score_model(model, since(m, "1999-01-01")).select("o_orderkey", "v", *seen(train, "prediction"))


@query("model_error", f"WITH {_M_SQL} SELECT {n('count(*)', 'n')}, true AS near_mean FROM m WHERE {_TEST}")
def model_error(t):
    """Orders have no signal to learn, so the ensemble's squared error must be that of the training mean but for a tenth."""
    m = matrix(t)
    train = before(m, "1999-01-01")
    models = M.fit_ensemble(train, PREPARED, "v", "o_orderdate", "o_orderkey", 3, prepare(), **SMALL)
    mean = train.agg(F.avg("v").alias("a")).scalar()
    scored = M.score_ensemble(models, since(m, "1999-01-01"))
    square = lambda x: F.avg((F.col("v") - x) * (F.col("v") - x))
    return scored.withColumn("__mean", mean).agg(F.count(F.lit(1)).alias("n"), (square(F.col("prediction")) <= 1.1 * square(F.col("__mean"))).alias("near_mean"))


@query("fit_variance", f"WITH {_M_SQL} SELECT o_orderkey, {r('v', 'v')}, true AS mean_pred_seen, true AS positive FROM m WHERE {_TEST}")
def fit_variance(t):
    m = matrix(t)
    mean = M.fit_gbt(before(m, "1998-01-01"), FEATURES, "v", prediction="mean_pred", **SMALL)
    middle = M.score_model(mean, since(before(m, "1999-01-01"), "1998-01-01"))
    variance = M.fit_variance(middle, FEATURES, "v", "mean_pred", **SMALL)
    scored = M.score_variance(variance, M.score_model(mean, since(m, "1999-01-01")))
    return scored.select("o_orderkey", "v", *seen(before(m, "1998-01-01"), "mean_pred"), (F.col("variance") >= PR.MIN_VARIANCE).alias("positive"))


@query("fit_ensemble", f"WITH {_M_SQL} SELECT o_orderkey, {r('v', 'v')}, true AS prediction_seen FROM m WHERE {_TEST}")
def fit_ensemble(t):
    m = matrix(t)
    train = before(m, "1999-01-01")
    models = M.fit_ensemble(train, PREPARED, "v", "o_orderdate", "o_orderkey", 3, prepare(), **SMALL)
    return M.score_ensemble(models, since(m, "1999-01-01")).select("o_orderkey", "v", *seen(train, "prediction"))


_BASE = ", ".join([r("avg(v)", "v_mean"), r("stddev_samp(v)", "v_std"), n("count(v)", "v_count")])


@query("fold_baselines", f"""WITH {O_SQL}, k AS (SELECT o_orderpriority, v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rk, count(*) OVER () AS c FROM o),
f AS (SELECT *, least(rk // (c // 3), 2) AS fold FROM k),
g AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rk) - 1 AS i, count(*) OVER (PARTITION BY fold) AS len FROM f),
x AS (SELECT * FROM g WHERE i < len - CAST(floor(len * 0.2e0) AS BIGINT))
SELECT {n('fold', 'fold')}, o_orderpriority, false AS all_rows, {_BASE}, {r('median(v)', 'v_median')} FROM x GROUP BY fold, o_orderpriority
UNION ALL SELECT {n('fold', 'fold')}, NULL, true, {_BASE}, {r('median(v)', 'v_median')} FROM x GROUP BY fold""")
def fold_baselines(t):
    """What the category baselines of three folds are fitted to, from one pass over their training rows."""
    parts = contiguous_folds(orders(t), "o_orderdate", "o_orderkey", 3).withColumn(M.HELD_OUT, F.col("split") == "val")
    found = M.fold_baselines(parts, CategoryBaselines(category="o_orderpriority", values=["v"]))
    return found.select("fold", "o_orderpriority", OVERALL, "v_mean", "v_std", "v_count", "v_median")


_WINDOWS = ("1998-07-01", "1999-01-01", "1999-07-01", "2000-01-01")
_WIN = "JOIN (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in _WINDOWS) + "]) AS refit) d ON CAST(o_orderdate AS DATE) >= refit - 730 AND CAST(o_orderdate AS DATE) < refit"


@query("walk_forward_windows", f"""WITH {O_SQL}, x AS (SELECT refit, o_orderpriority, CASE WHEN v < 250 THEN v END AS v FROM o {_WIN})
SELECT refit, o_orderpriority, false AS all_rows, {n('count(*)', 'train_rows')}, {_BASE} FROM x GROUP BY refit, o_orderpriority
UNION ALL SELECT refit, NULL, true, {n('count(*)', 'train_rows')}, {_BASE} FROM x GROUP BY refit""")
def walk_forward_windows(t):
    """Sizes and baselines of the two-year windows before all refit dates, from one pass."""
    some = orders(t).withColumn("v", F.when(F.col("v") < 250, F.col("v")))
    return M.refit_windows(some, "o_orderdate", _WINDOWS, 2, CategoryBaselines(category="o_orderpriority", values=["v"]))


@query("category_features", f"""WITH {O_SQL}, x AS (SELECT *, CASE WHEN v < 250 THEN v END AS w FROM o),
b AS (SELECT o_orderpriority, median(w) AS md, avg(w) AS av, stddev_samp(w) AS sd FROM x WHERE NOT {_TEST} AND o_orderpriority <> '1-URGENT' GROUP BY 1),
a AS (SELECT median(w) AS md FROM x WHERE NOT {_TEST} AND o_orderpriority <> '1-URGENT'),
y AS (SELECT o_orderkey, coalesce(w, b.md, a.md) AS f, av, sd FROM x LEFT JOIN b USING (o_orderpriority), a WHERE {_TEST})
SELECT o_orderkey, {r('f', 'w_filled')}, {r('coalesce(f - av, 0)', 'w_vs_group')}, {r('coalesce((f - av) / nullif(sd, 0), 0)', 'w_group_z')} FROM y""")
def category_features(t):
    """A stage fitted on earlier orders, one priority of which was never seen, stored, read back and applied to later ones."""
    some = orders(t).withColumn("w", F.when(F.col("v") < 250, F.col("v")))
    train = before(some, "1999-01-01").filter("o_orderpriority <> '1-URGENT'")
    path = work_path(t.spark, "stage")
    CategoryBaselines(category="o_orderpriority", values=["w"], method="median").fit(train).save(path)
    fitted = M.CategoryBaselinesModel.load(path)
    return fitted.transform(since(some, "1999-01-01")).select("o_orderkey", *fitted.outputs())


_STARTS, _END = ["1999-01-01", "2000-01-01"], "2001-01-01"


def forward(t):
    return M.walk_forward(
        matrix(t), PREPARED, "v", "o_orderdate", "o_orderkey", _STARTS, _END, 3, 2,
        keep=("o_orderkey", "o_custkey"), prepare=prepare(), variance=True, least_rows=100, trees=5, depth=3,
    )


@query("walk_forward", f"""WITH {_M_SQL}, w AS (SELECT a.o_orderkey, count(b.o_orderkey) AS c FROM (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN DATE '1999-01-01' ELSE DATE '2000-01-01' END AS refit FROM m WHERE {_TEST} AND o_orderdate < TIMESTAMP '2001-01-01') a
JOIN m b ON b.o_orderdate < a.refit AND b.o_orderdate >= a.refit - 1095 GROUP BY 1 HAVING c >= 100)
SELECT o_orderkey, o_custkey, {r('v', 'v')}, true AS prediction_seen, true AS positive, CAST(o_orderdate AS DATE) AS day FROM m JOIN w USING (o_orderkey)""")
def walk_forward(t):
    found = forward(t)
    return found.select("o_orderkey", "o_custkey", "v", *seen(before(orders(t), _END), "prediction"), (F.col("variance") >= PR.MIN_VARIANCE).alias("positive"), F.to_date("o_orderdate").alias("day"))


_KELLY_SIDE = "coalesce({p} - " + BREAK_EVEN + " >= 0.03e0, false) AND abs(po - 0.5e0) / 0.5e0 >= 0.6e0 AND sqrt(a2) / b2 / (mean_pred + 1e-6) <= 0.9e0"


@query("walk_forward_decisions", f"""WITH {S_SQL}, x AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM s WHERE mean_pred IS NOT NULL AND var_pred IS NOT NULL),
cut AS (SELECT quantile_cont(d, 0.2) AS cut FROM (SELECT DISTINCT d FROM x)),
q AS (SELECT quantile_cont(abs(actual - mean_pred), 0.68) AS q FROM x, cut WHERE d < cut),
c AS (SELECT x.*, alpha / beta AS m, alpha / (beta * beta) + q * q AS vc FROM x, q, cut WHERE d >= cut AND line IS NOT NULL),
e AS (SELECT *, greatest(m * m / vc, 0.1e0) AS a2, greatest(m / vc, 0.01e0) AS b2 FROM c),
z AS (SELECT *, 1 - {gamma_cdf_sql('a2', 'b2 * line')} AS po FROM e)
SELECT o_orderkey, {r('po', 'prob_over')}, {r(f'po - {BREAK_EVEN}', 'edge_over')}, {_KELLY_SIDE.format(p='po')} AS should_bet_over, {_KELLY_SIDE.format(p='(1 - po)')} AS should_bet_under,
mean_pred > line AS bet_over, (actual > line) = (mean_pred > line) AS bet_correct, {r("CASE WHEN (actual > line) = (mean_pred > line) THEN 0.909e0 ELSE -1e0 END", 'profit')} FROM z""")
def walk_forward_decisions(t):
    """Lagged means as predictions of a walk-forward run: calibrated on the first fifth of the days, decided on the others."""
    pred = predictions(t).withColumnsRenamed({"mean_pred": "prediction_", "var_pred": "variance"}).drop("prediction")
    pred = pred.withColumnRenamed("prediction_", "prediction").filter("prediction IS NOT NULL AND variance IS NOT NULL")
    lines = pred.select("o_orderkey", "line")
    out = M.decide(pred.drop("line"), lines, "o_orderkey", "o_orderdate", "actual", share=0.2, alpha=0.32, max_cv=0.9, hot_rows=t.hot_rows)
    return out.select("o_orderkey", "prob_over", "edge_over", "should_bet_over", "should_bet_under", "bet_over", "bet_correct", "profit")


_DAY = "TIMESTAMP '2001-07-01'"


@query("predict_day", f"""WITH {_M_SQL}, x AS (SELECT * FROM m WHERE o_orderdate < {_DAY}),
g AS (SELECT o_custkey, max_by(v, (o_orderdate, o_orderkey)) AS last FROM x GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-07-01') >= 3)
SELECT o_custkey, {r('floor(last) + 0.5', 'line')}, {r('-110', 'odds')}, 'FanDuel' AS bookmaker, true AS mean_pred_seen, true AS positive, true AS sides FROM g""")
def predict_day(t):
    """Latest features per customer before a day, filter, mean and variance, two sources' lines, preferred source."""
    m, k = matrix(t), order_keys(t)
    train = before(m, "2001-01-01")
    mean = M.fit_gbt(train, FEATURES, "v", prediction="mean_pred", **SMALL)
    variance = M.fit_variance(M.score_model(mean, train), FEATURES, "v", "mean_pred", **SMALL)
    day = F.lit("2001-07-01").cast("timestamp_ntz")
    counts = before(m, "2001-07-01").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("career_games"), F.count_if(F.col("o_orderdate") >= F.lit("2000-07-01").cast("timestamp_ntz")).alias("recent_games")
    )
    latest = asof_latest(m, k, FEATURES, day).join(counts, "o_custkey")
    upcoming = player_filter(latest)
    scored = M.score_variance(variance, M.score_model(mean, upcoming)).withColumn("std_dev", F.sqrt("variance"))
    last = asof_latest(m, k, ["v"], day).select("o_custkey", (F.floor("v") + 0.5).alias("line"))
    books = last.withColumn("bookmaker", F.explode(F.array(F.lit("FanDuel"), F.lit("Other")))).withColumn(
        "odds", F.when(F.col("bookmaker") == "Other", -105.0)
    )
    lined = join_multi_line(scored, books, "o_custkey", "line", "odds", "mean_pred", -110.0)
    fitted = PR.prob_over(PR.gamma_fit(lined, "mean_pred", "variance"), "line_for_prob")
    decided = bet_decision_prob(fitted, "prob_over", "std_dev", "mean_pred", F.col("odds"), max_cv=0.9)
    picked = pick_preferred(decided, "o_custkey", "bookmaker", ["fanduel", "draftkings"], ["line"])
    both = F.abs(F.col("prob_over") + F.col("prob_under") - 1) < 1e-9
    return picked.select(
        "o_custkey", "line", "odds", "bookmaker", *seen(train, "mean_pred"), (F.col("std_dev") > 0).alias("positive"),
        (both & (F.col("edge_over") + F.col("edge_under") < 0)).alias("sides"),
    )


@query("walk_forward_evaluation")
def walk_forward_evaluation(t):
    """Walk-forward predictions with a conformal calibrator from the first fifth of the days, decisions and tiers."""
    pred = stored(forward(t), "walk-forward-scored")
    # The line is the customer's value two orders before.
    line = {"line": lambda w: F.floor(F.lag("v", 2).over(w)) + 0.5}
    lines = on_timeline(orders(t), order_keys(t).with_(season=None), lambda tl: tl.look_back(2, line), reach=2)
    return edge_tiers(M.decide(pred, lines, "o_orderkey", "o_orderdate", "v", alpha=0.32, max_cv=1.5, hot_rows=t.hot_rows))
