"""Queries of the accuracy, probability, decision, performance and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.keys import Keys
from chronoplane.operators import accuracy as AC
from chronoplane.operators import decisions as D
from chronoplane.operators import ledger as L
from chronoplane.operators import performance as PF
from chronoplane.operators import probability as PR
from chronoplane.operators import relational as R
from chronoplane.plans.bindings import (
    B_SQL,
    P_SQL,
    PB_SQL,
    S_SQL,
    bets,
    gamma_cdf_sql,
    order_keys,
    prob_bets,
    predictions,
    scored,
)
from chronoplane.plans.registry import n, query, r

_HELD = "h AS (SELECT *, actual - prediction AS e FROM p WHERE prediction IS NOT NULL)"


# --- accuracy --------------------------------------------------------------------------------------------

_METRICS = f"""{n('count(*)', 'n')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(abs(e))', 'mae')}, {r('1 - sum(e * e) / (var_pop(actual) * count(*))', 'r2')},
{r('avg(abs(e) / abs(actual)) * 100', 'mape')}, {r('avg(e)', 'residual_mean')}, {r('stddev_pop(e)', 'residual_std')}, {r('max(abs(e))', 'residual_max')},
{r('quantile_cont(abs(e), 0.5)', 'median_ae')}"""


@query("regression_metrics", f"WITH {P_SQL}, {_HELD} SELECT {_METRICS} FROM h")
def regression_metrics(t):
    return AC.regression_metrics(predictions(t), "actual", "prediction", hot_rows=t.hot_rows)


@query("regression_metrics_by_season", f"WITH {P_SQL}, {_HELD} SELECT season, {_METRICS} FROM h GROUP BY 1")
def regression_metrics_by_season(t):
    return AC.regression_metrics(predictions(t), "actual", "prediction", "season", t.hot_rows)


@query("residual_table", f"""WITH {P_SQL}, {_HELD} SELECT o_orderkey, {r('actual', 'actual')}, {r('prediction', 'predicted')}, {r('e', 'residual')}, {r('abs(e)', 'abs_error')} FROM h""")
def residual_table(t):
    held = predictions(t).filter(F.col("prediction").isNotNull())
    return R.residual_table(held, "actual", "prediction", "o_orderkey")


@query("residual_summary", f"""WITH {P_SQL}, {_HELD}, s AS (SELECT avg(e) AS m, stddev_pop(e) AS sd FROM h)
SELECT {r('avg(e)', 'mean')}, {r('stddev_pop(e)', 'std')}, {r('min(e)', 'min')}, {r('max(e)', 'max')}, {n('count(*) FILTER (abs((e - m) / sd) > 3)', 'n_outliers')},
{r('count(*) FILTER (abs((e - m) / sd) > 3) * 100e0 / count(*)', 'pct_outliers')}, {r('quantile_cont(e, 0.25)', 'q25')}, {r('quantile_cont(e, 0.5)', 'median')}, {r('quantile_cont(e, 0.75)', 'q75')} FROM h, s""")
def residual_summary(t):
    return AC.residual_summary(predictions(t), "actual", "prediction", t.hot_rows)


@query("error_by_range", f"""WITH {P_SQL}, {_HELD}, l AS (SELECT min(prediction) AS lo, max(prediction) AS hi FROM h),
b AS (SELECT *, greatest(least(ceil((prediction - lo) / (hi - lo) * 5) - 1, 4), 0) AS bin FROM h, l)
SELECT {n('bin', 'bin')}, {n('count(*)', 'n')}, {r('avg(abs(e))', 'mean_abs_error')} FROM b GROUP BY bin""")
def error_by_range(t):
    return AC.error_by_range(predictions(t), "actual", "prediction")


@query("temporal_stability", f"""WITH {P_SQL}, {_HELD}, d AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM h),
m AS (SELECT quantile_cont(day, 0.5) AS m FROM d), x AS (SELECT CASE WHEN day < m THEN e END AS a, CASE WHEN day >= m THEN e END AS b FROM d, m)
SELECT {r('sqrt(avg(a * a))', 'rmse_early')}, {r('sqrt(avg(b * b))', 'rmse_late')}, {r('var_pop(a)', 'var_early')}, {r('var_pop(b)', 'var_late')}, {r('avg(a)', 'bias_early')}, {r('avg(b)', 'bias_late')},
{r('sqrt(avg(b * b)) / sqrt(avg(a * a))', 'rmse_ratio')}, {r('var_pop(b) / var_pop(a)', 'var_ratio')} FROM x""")
def temporal_stability(t):
    return AC.temporal_stability(predictions(t), "actual", "prediction", "o_orderdate", t.hot_rows)


@query("cv_summary", f"""WITH {P_SQL}, {_HELD}, f AS (SELECT season, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM h GROUP BY 1),
l AS (SELECT 'rmse' AS metric, rmse AS x FROM f UNION ALL SELECT 'mae', mae FROM f)
SELECT metric, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')}, {r('stddev_pop(x) / nullif(avg(x), 0)', 'cv')} FROM l GROUP BY 1""")
def cv_summary(t):
    per = AC.regression_metrics(predictions(t), "actual", "prediction", "season", t.hot_rows)
    return AC.cv_summary(per, "season", ["rmse", "mae"])


@query("ensemble_mean", f"""WITH {P_SQL}, m AS (SELECT o_orderkey, prediction AS x, var_pred AS w FROM p UNION ALL SELECT o_orderkey, mean_pred, var_pred / 2 FROM p UNION ALL SELECT o_orderkey, line, NULL FROM p)
SELECT o_orderkey, {r('avg(x)', 'prediction')}, {n('count(x)', 'n_models')}, {r('avg(w)', 'variance')} FROM m GROUP BY 1""")
def ensemble_mean(t):
    p = predictions(t)
    one = [("prediction", F.col("var_pred")), ("mean_pred", F.col("var_pred") / 2), ("line", F.lit(None).cast("double"))]
    stacked = p.select(
        "o_orderkey",
        F.explode(F.array(*[F.struct(F.col(c).alias("x"), w.alias("w")) for c, w in one])).alias("m"),
    ).select("o_orderkey", "m.x", "m.w")
    return AC.ensemble_mean(stacked, "o_orderkey", "x", "w")


# --- probability -----------------------------------------------------------------------------------------

_A = "a AS (SELECT * FROM s WHERE alpha IS NOT NULL)"


@query("gamma_fit", f"WITH {S_SQL} SELECT o_orderkey, {r('alpha', 'alpha')}, {r('beta', 'beta')} FROM s")
def gamma_fit(t):
    return scored(t).select("o_orderkey", "alpha", "beta")


@query("gamma_moments", f"WITH {S_SQL} SELECT o_orderkey, {r('alpha / beta', 'gamma_mean')}, {r('sqrt(alpha) / beta', 'gamma_std')} FROM s")
def gamma_moments(t):
    return PR.gamma_moments(scored(t)).select("o_orderkey", "gamma_mean", "gamma_std")


@query("gamma_tail", f"WITH {S_SQL}, {_A} SELECT o_orderkey, {r('1 - ' + gamma_cdf_sql('alpha', 'beta * line'), 'prob_over')} FROM a")
def gamma_tail(t):
    return PR.prob_over(scored(t).filter(F.col("alpha").isNotNull()), "line").select("o_orderkey", "prob_over")


def _quantiles_sql(levels) -> str:
    """Quantiles of the Gamma distributions by bisection: a column per level, keyed by order."""
    rows = ", ".join(f"{p!r}e0" for p in levels.values())
    picks = ", ".join(f"max(CASE WHEN p = {p!r}e0 THEN (lo + hi) / 2 / beta END) AS {name}" for name, p in levels.items())
    return f"""gb AS (
  SELECT o_orderkey, alpha, beta, p, 0e0 AS lo, alpha + 12 * sqrt(alpha) + 40 AS hi, 0 AS i FROM s, (SELECT unnest([{rows}]) AS p) WHERE alpha IS NOT NULL
  UNION ALL
  SELECT o_orderkey, alpha, beta, p, CASE WHEN f < p THEN m ELSE lo END, CASE WHEN f < p THEN hi ELSE m END, i + 1
  FROM (SELECT *, (lo + hi) / 2 AS m, {gamma_cdf_sql('alpha', '((lo + hi) / 2)')} AS f FROM gb WHERE i < 50)),
gq AS (SELECT o_orderkey, {picks} FROM gb WHERE i = 50 GROUP BY 1)"""


_GQ = {"lower": 0.025, "upper": 0.975, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


@query("gamma_quantile", f"WITH RECURSIVE {S_SQL}, {_quantiles_sql(_GQ)} SELECT o_orderkey, {', '.join(r(c, c) for c in _GQ)} FROM gq")
def gamma_quantile(t):
    held = scored(t).filter(F.col("alpha").isNotNull())
    out = PR.quantiles(PR.interval(held), {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    return out.select("o_orderkey", "lower", "upper", "q05", "q25", "q50", "q75", "q95")


@query("gamma_quantile_inverse", f"""WITH {S_SQL}, {_A} SELECT o_orderkey, {r('0.05', 'p05')}, {r('0.5', 'p50')}, {r('0.95', 'p95')} FROM a""")
def gamma_quantile_inverse(t):
    """The distribution function at the quantiles gives the levels back."""
    from chronoplane.functions.special import gamma_cdf

    held = scored(t).filter(F.col("alpha").isNotNull())
    q = PR.quantiles(held, {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return q.select(
        "o_orderkey", *[gamma_cdf(F.col("alpha"), F.col("beta"), F.col(f"q{p}")).alias(f"p{p}") for p in ("05", "50", "95")]
    )


_PIT = f"u AS (SELECT o_orderkey, (actual - alpha / beta) / (sqrt(alpha) / beta) AS z, {gamma_cdf_sql('alpha', 'beta * actual')} AS pit FROM a)"


@query("fit_diagnostics", f"""WITH {S_SQL}, {_A}, {_PIT}, k AS (SELECT *, row_number() OVER (ORDER BY pit, o_orderkey) AS i, count(*) OVER () AS c FROM u),
d AS (SELECT avg(abs(z)) AS az, max(greatest(i / c - pit, pit - (i - 1) / c)) AS ks, max(c) AS c FROM k),
pv AS (SELECT *, CASE WHEN ks * sqrt(c) < 0.2 THEN 1e0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2e0 * j * j * ks * ks * c))), 0), 1) END AS pvalue FROM d)
SELECT {r('az', 'mean_abs_z')}, {r('ks', 'ks_statistic')}, {r('pvalue', 'ks_pvalue')}, {n('c', 'n')}, pvalue > 0.05 AS is_well_fitted FROM pv""")
def fit_diagnostics(t):
    return PR.fit_diagnostics(scored(t), "actual", "o_orderkey", t.hot_rows)


_CONF = """q AS (SELECT quantile_cont(abs(actual - mean_pred), 0.95) AS q FROM a WHERE o_orderdate < TIMESTAMP '1998-01-01'),
c AS (SELECT a.*, alpha / beta AS m, alpha / (beta * beta) + q * q AS vc FROM a, q)"""


@query("conformal", f"WITH {S_SQL}, {_A}, {_CONF} SELECT o_orderkey, {r('greatest(m * m / vc, 0.1)', 'alpha_cal')}, {r('greatest(m / vc, 0.01)', 'beta_cal')} FROM c")
def conformal(t):
    held = scored(t).filter(F.col("alpha").isNotNull())
    val = held.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return PR.conformal(held, val, "actual", "mean_pred", 0.05, t.hot_rows).select("o_orderkey", "alpha_cal", "beta_cal")


_TH = f"""th AS (SELECT unnest([0, 1, 2, 3, 4]) AS no, unnest(quantile_cont(actual, [0.1, 0.25, 0.5, 0.75, 0.9])) AS threshold FROM a),
pt AS (SELECT no, actual > threshold AS hit, 1 - {gamma_cdf_sql('alpha', 'beta * threshold')} AS p FROM a, th)"""
_BINS = """cb AS (SELECT no, floor(p * 10) AS bin, count(*) AS c, avg(p) AS pp, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS af FROM pt WHERE floor(p * 10) < 10 GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("calibration_bins", f"""WITH {S_SQL}, {_A}, {_TH}, {_BINS} SELECT {n('no', 'threshold_no')}, {n('bin', 'bin')}, {n('c', 'n_samples')}, {r('pp', 'predicted_prob')}, {r('af', 'actual_freq')}, {r('abs(pp - af)', 'error')} FROM cb""")
def calibration_bins(t):
    return PR.calibration_bins(scored(t), "actual", hot_rows=t.hot_rows)


@query("ece", f"""WITH {S_SQL}, {_A}, {_TH}, {_BINS} SELECT {r('sum(abs(pp - af) * c) / (SELECT count(*) FROM a)', 'ece')}, {n('(SELECT count(*) FROM a)', 'n_samples')} FROM cb""")
def ece(t):
    return PR.ece(scored(t), "actual", hot_rows=t.hot_rows)


def _cov(level):
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    share = f"avg(CASE WHEN pit BETWEEN {lo!r} AND {hi!r} THEN 1e0 ELSE 0e0 END)"
    return f"""SELECT {n('count(*)', 'n')}, {r(level, 'expected')}, {r(share, 'actual')}, {r(f'abs({share} - {level}e0)', 'error')}, abs({share} - {level}e0) < 0.03e0 AS is_valid FROM u"""


@query("coverage", f"WITH {S_SQL}, {_A}, {_PIT} " + " UNION ALL ".join(_cov(x) for x in (0.68, 0.8, 0.9, 0.95)))
def coverage(t):
    return PR.coverage(scored(t), "actual")


@query("coverage_curve", f"WITH {S_SQL}, {_A}, {_PIT} " + " UNION ALL ".join(_cov(round(0.5 + 0.05 * i, 2)) for i in range(10)))
def coverage_curve(t):
    return PR.coverage(scored(t), "actual", tuple(round(0.5 + 0.05 * i, 2) for i in range(10)))


_WIDTHS = {f"{side}{i}": (1 - level) / 2 if side == "l" else 1 - (1 - level) / 2 for i, level in enumerate(PR.LEVELS) for side in "lu"}


@query("sharpness", f"WITH RECURSIVE {S_SQL}, {_quantiles_sql(_WIDTHS)} " + " UNION ALL ".join(f"SELECT {r(level, 'level')}, {r(f'avg(u{i} - l{i})', 'mean_width')} FROM gq" for i, level in enumerate(PR.LEVELS)))
def sharpness(t):
    return PR.sharpness(scored(t))


@query("pit_diagnosis", f"""WITH {S_SQL}, {_A}, {_PIT}, d AS (SELECT count(*) AS c, avg(pit) AS m, stddev_pop(pit) AS sd,
  avg(CASE WHEN least(floor(pit * 10), 9) IN (0, 9) THEN 1e0 ELSE 0e0 END) AS es, avg(CASE WHEN least(floor(pit * 10), 9) IN (4, 5) THEN 1e0 ELSE 0e0 END) AS ms FROM u)
SELECT {n('c', 'n')}, {r('m', 'pit_mean')}, {r('es', 'edge_share')}, {r('ms', 'middle_share')}, {r('sd', 'pit_std')},
CASE WHEN es > 1.5 * ms THEN 'OVERCONFIDENT' WHEN ms > 1.5 * es THEN 'UNDERCONFIDENT' WHEN m < 0.4 THEN 'NEGATIVE_BIAS' WHEN m > 0.6 THEN 'POSITIVE_BIAS' ELSE 'NONE' END AS issue FROM d""")
def pit_diagnosis(t):
    return PR.pit_diagnosis(scored(t), "actual")


@query("brier", f"""WITH {S_SQL}, {_A}, {_TH}, b AS (SELECT no, avg((p - CASE WHEN hit THEN 1e0 ELSE 0e0 END) * (p - CASE WHEN hit THEN 1e0 ELSE 0e0 END)) AS b FROM pt GROUP BY 1)
SELECT {r('avg(b)', 'brier')} FROM b""")
def brier(t):
    return PR.brier(scored(t), "actual", hot_rows=t.hot_rows)


@query("variance_quality", f"""WITH {S_SQL}, h AS (SELECT *, actual - mean_pred AS e FROM s WHERE var_pred IS NOT NULL)
SELECT {n('count(*)', 'n')}, {r('corr(var_pred, e * e)', 'variance_corr')}, {r('avg(var_pred) / avg(e * e)', 'variance_ratio')},
{r('avg(CASE WHEN abs(e) <= sqrt(var_pred) THEN 1e0 ELSE 0e0 END)', 'coverage_68')}, {r('avg(CASE WHEN abs(e) <= 1.96e0 * sqrt(var_pred) THEN 1e0 ELSE 0e0 END)', 'coverage_95')} FROM h""")
def variance_quality(t):
    return PF.variance_quality(predictions(t), "actual", "mean_pred", "var_pred")


# --- decisions -------------------------------------------------------------------------------------------

@query("bet_decision_point", f"WITH {B_SQL} SELECT o_orderkey, bet_over, {r('edge_size', 'edge_size')} FROM b")
def bet_decision_point(t):
    held = predictions(t).filter(F.col("prediction").isNotNull())
    return D.bet_decision_point(held, "prediction", "line").select("o_orderkey", "bet_over", "edge_size")


@query("bet_outcome", f"WITH {B_SQL} SELECT o_orderkey, has_line, bet_correct, {r('profit', 'profit')} FROM b")
def bet_outcome(t):
    return bets(t).select("o_orderkey", "has_line", "bet_correct", "profit")


_SIDES = ("edge_over", "edge_under", "kelly_size_over", "kelly_size_under", "confidence_score", "cv", "bet_size_over", "bet_size_under", "prob_over", "prob_under")


@query("bet_decision_prob", f"WITH {PB_SQL} SELECT o_orderkey, should_bet_over, should_bet_under, {', '.join(r(c, c) for c in _SIDES)} FROM pb")
def bet_decision_prob(t):
    return prob_bets(t).select("o_orderkey", "should_bet_over", "should_bet_under", *_SIDES)


_BEST_SQL = """best0 AS (SELECT *, CASE WHEN should_bet_over AND (NOT should_bet_under OR edge_over > edge_under) THEN 'OVER' WHEN should_bet_under THEN 'UNDER' END AS direction FROM pb),
best AS (SELECT *, CASE WHEN direction = 'OVER' THEN edge_over ELSE edge_under END AS edge, CASE WHEN direction = 'OVER' THEN prob_over ELSE prob_under END AS prob_win,
  CASE WHEN direction = 'OVER' THEN kelly_size_over ELSE kelly_size_under END AS kelly_size FROM best0 WHERE direction IS NOT NULL)"""


def best_bets(t):
    base = prob_bets(t).drop("edge_over", "edge_under", "confidence_score", "cv", "should_bet_over", "should_bet_under")
    return D.bet_decision_best(base, "prob_over", "std_pred", "mean_pred", max_cv=0.8)


@query("bet_decision_best", f"WITH {PB_SQL}, {_BEST_SQL} SELECT o_orderkey, direction, {r('edge', 'edge')}, {r('prob_win', 'prob_win')}, {r('kelly_size', 'kelly_size')}, {r('confidence_score', 'confidence_score')} FROM best")
def bet_decision_best(t):
    return best_bets(t).select("o_orderkey", "direction", "edge", "prob_win", "kelly_size", "confidence_score")


@query("recommend", f"""WITH {PB_SQL}, x AS (SELECT *, CASE WHEN edge_over > edge_under THEN 'OVER' ELSE 'UNDER' END AS direction, greatest(edge_over, edge_under) AS edge FROM pb)
SELECT o_orderkey, direction, {r('edge', 'edge')}, CASE WHEN edge >= 0.15 AND confidence_score >= 0.85 THEN 'STRONG' WHEN edge >= 0.10 AND confidence_score >= 0.75 THEN 'GOOD' ELSE 'OK' END AS strength
FROM x WHERE edge >= 0.05e0 AND confidence_score >= 0.7e0 AND cv <= 0.7e0""")
def recommend(t):
    return D.recommend(prob_bets(t), 0.05, 0.7, 0.7).select("o_orderkey", "direction", "edge", "strength")


@query("confidence_filter", f"WITH {PB_SQL} SELECT o_orderkey, {r('prob_over', 'prob_over')} FROM pb WHERE confidence_score >= 0.7e0 AND cv <= 0.6e0")
def confidence_filter(t):
    return D.confidence_filter(prob_bets(t), "prob_over", "std_pred", "mean_pred", 0.7, 0.6).select("o_orderkey", "prob_over")


@query("expected_value", f"WITH {PB_SQL} SELECT o_orderkey, {r('prob_over * (100e0 / 110e0) - (1 - prob_over)', 'ev_over')}, {r('(1 - prob_over) * (100e0 / 110e0) - prob_over', 'ev_under')} FROM pb")
def expected_value(t):
    return D.expected_value(prob_bets(t), "prob_over").select("o_orderkey", "ev_over", "ev_under")


@query("topk_edge", f"WITH {PB_SQL}, {_BEST_SQL} SELECT o_orderkey, direction, {r('edge', 'edge')} FROM best ORDER BY edge DESC, o_orderkey LIMIT 20")
def topk_edge(t):
    return R.topk_edge(best_bets(t), 20, tie="o_orderkey").select("o_orderkey", "direction", "edge")


# --- performance -----------------------------------------------------------------------------------------

@query("bet_totals", f"""WITH {B_SQL}, l AS (SELECT * FROM b WHERE has_line), c AS (SELECT *, sum(profit) OVER (ORDER BY o_orderdate, o_custkey, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM l),
a AS (SELECT count(*) AS c, count(*) FILTER (bet_correct) AS w, sum(profit) AS p, max(cum) AS hi, min(cum) AS lo FROM c)
SELECT {n('c', 'total_bets')}, {n('w', 'wins')}, {n('c - w', 'losses')}, {r('p', 'total_profit')}, {r('hi', 'max_cumulative_profit')}, {r('lo', 'min_cumulative_profit')}, {r('w / c', 'win_rate')},
{r('(w / c - 0.524e0) * 100', 'win_rate_vs_breakeven')}, w / c > 0.524e0 AS is_profitable, {r('p / c * 100', 'roi')}, {r('p', 'final_cumulative_profit')} FROM a""")
def bet_totals(t):
    return PF.bet_totals(bets(t), order_keys(t))


@query("edge_tiers", f"WITH {B_SQL} " + " UNION ALL ".join(
    f"SELECT '{k}' AS tier, {r(e, 'threshold')}, {n('count(*)', 'edge_count')}, {r('avg(CASE WHEN bet_correct THEN 1e0 ELSE 0e0 END)', 'edge_win_rate')}, {r('avg(profit) * 100', 'edge_roi')}, {r('avg(profit)', 'edge_avg_profit')} FROM b WHERE has_line AND edge_size >= {e}"
    for k, e in (("small", 1), ("medium", 2), ("large", 3))))
def edge_tiers(t):
    return PF.edge_tiers(bets(t))


_BY_PLAYER = """bp AS (SELECT o_custkey, count(*) AS c, count(*) FILTER (bet_correct) AS w, sum(profit) AS p, avg(edge_size) AS e FROM b WHERE has_line GROUP BY 1 HAVING count(*) >= 8)"""


@query("by_player", f"WITH {B_SQL}, {_BY_PLAYER} SELECT o_custkey, {n('w', 'wins')}, {n('c', 'num_games')}, {r('w / c', 'win_rate')}, {r('p', 'total_profit')}, {r('p / c', 'avg_profit')}, {r('e', 'avg_edge')}, {r('p / c * 100', 'roi')} FROM bp")
def by_player(t):
    return PF.by_player(bets(t), "o_custkey", 8)


@query("top_bottom_roi", f"""WITH {B_SQL}, {_BY_PLAYER}, x AS (SELECT o_custkey, round(p / c * 100, 6) AS roi FROM bp)
SELECT * FROM (SELECT o_custkey, {r('roi', 'roi')}, 'top' AS side FROM x ORDER BY x.roi DESC, o_custkey LIMIT 10) UNION ALL
SELECT * FROM (SELECT o_custkey, {r('roi', 'roi')}, 'bottom' FROM x ORDER BY x.roi, o_custkey LIMIT 10)""")
def top_bottom_roi(t):
    stats = PF.by_player(bets(t), "o_custkey", 8).select("o_custkey", F.round("roi", 6).alias("roi"))
    return R.top_bottom_roi(stats, 10, tie="o_custkey")


_DAYS = """dd AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS c, count(*) FILTER (bet_correct) AS w, sum(profit) AS p FROM b WHERE has_line GROUP BY 1)"""
_RUN = "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("by_day", f"WITH {B_SQL}, {_DAYS} SELECT day, {n('w', 'wins')}, {n('c', 'num_bets')}, {r('p', 'daily_profit')}, {r('w / c', 'win_rate')}, {r('p / c', 'avg_profit')}, {r('p / c * 100', 'roi')}, {r(f'sum(p) {_RUN}', 'cumulative_profit')} FROM dd")
def by_day(t):
    return PF.by_day(bets(t), "o_orderdate")


@query("cumulative_sum", f"WITH {B_SQL}, {_DAYS} SELECT day, {n(f'sum(c) {_RUN}', 'cumulative_bets')}, {n(f'sum(w) {_RUN}', 'cumulative_wins')}, {r(f'sum(p) {_RUN}', 'cumulative_profit')}, {r(f'sum(w) {_RUN} / sum(c) {_RUN}', 'cumulative_win_rate')} FROM dd")
def cumulative_sum(t):
    out = PF.cumulative_sum(PF.daily_totals(bets(t), "o_orderdate"))
    return out.select("day", "cumulative_bets", "cumulative_wins", "cumulative_profit", "cumulative_win_rate")


@query("drawdown", f"""WITH {B_SQL}, {_DAYS}, c AS (SELECT day, p, sum(p) {_RUN} AS cum FROM dd), k AS (SELECT *, max(cum) {_RUN} AS peak FROM c), d AS (SELECT *, cum - peak AS dd FROM k),
a AS (SELECT arg_min(peak, (dd, day)) AS pk, min(dd) AS dd, avg(CASE WHEN dd < 0 THEN 1e0 ELSE 0e0 END) AS t, sum(p) AS p FROM d)
SELECT {r('dd', 'max_drawdown')}, {r('CASE WHEN pk > 0 THEN dd / pk * 100 ELSE 0 END', 'max_drawdown_pct')}, {r('t', 'time_in_drawdown')}, {r('p', 'total_profit')}, {r('abs(p / nullif(dd, 0))', 'profit_to_drawdown')} FROM a""")
def drawdown(t):
    return PF.drawdown(PF.daily_totals(bets(t), "o_orderdate"))


_ROLL = "rr AS (SELECT day, CASE WHEN count(*) OVER w = 30 THEN sum(w) OVER w / sum(c) OVER w END AS rate FROM dd WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"


@query("rolling_rate", f"WITH {B_SQL}, {_DAYS}, {_ROLL} SELECT day, {r('rate', 'rolling_win_rate')} FROM rr")
def rolling_rate(t):
    return PF.rolling_rate(PF.daily_totals(bets(t), "o_orderdate")).select("day", "rolling_win_rate")


@query("rolling_rate_summary", f"""WITH {B_SQL}, {_DAYS}, {_ROLL} SELECT {n('count(rate)', 'windows')}, {r('avg(rate)', 'mean')}, {r('stddev_samp(rate)', 'std')}, {r('min(rate)', 'min')}, {r('max(rate)', 'max')},
{r('avg(CASE WHEN rate > 0.524e0 THEN 1e0 WHEN rate IS NOT NULL THEN 0e0 END)', 'share_above')}, {r('quantile_cont(rate, 0.25)', 'q25')}, {r('quantile_cont(rate, 0.5)', 'median')}, {r('quantile_cont(rate, 0.75)', 'q75')} FROM rr""")
def rolling_rate_summary(t):
    return PF.rolling_rate_summary(PF.daily_totals(bets(t), "o_orderdate"))


_THIRDS = """pt AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () // 3 AS k FROM dd),
th AS (SELECT CASE WHEN i < k THEN 'early' WHEN i < 2 * k THEN 'middle' ELSE 'late' END AS period, sum(c) AS c, sum(w) AS w, sum(p) AS p FROM pt GROUP BY 1),
tt AS (SELECT sum(c) AS c, sum(w) AS w FROM th), ch AS (SELECT sum((th.w - th.c * tt.w / tt.c) * (th.w - th.c * tt.w / tt.c) / (th.c * tt.w / tt.c * (1 - tt.w / tt.c))) AS x FROM th, tt)"""


@query("period_thirds", f"""WITH {B_SQL}, {_DAYS}, {_THIRDS} SELECT period, {n('c', 'bets')}, {n('w', 'wins')}, {r('w / c', 'win_rate')}, {r('p / c', 'roi')}, {r('x', 'chi2')}, {r('exp(-x / 2)', 'p_value')} FROM th, ch""")
def period_thirds(t):
    return PF.period_thirds(PF.daily_totals(bets(t), "o_orderdate"))


def _wilson(z, side):
    sign = "-" if side == "low" else "+"
    return f"((w / c + {z}e0 * {z}e0 / (2 * c)) {sign} {z}e0 * sqrt(w / c * (1 - w / c) / c + {z}e0 * {z}e0 / (4e0 * c * c))) / (1 + {z}e0 * {z}e0 / c)"


_Z = {90: "1.6448536269514722", 95: "1.959963984540054", 99: "2.5758293035489004"}
_BINOM = "list_sum(list_transform(range(w, c + 1), lambda i: exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) + i * ln(0.524e0) + (c - i) * ln(0.476e0))))"
_SIG = f"""{n('c', 'n')}, {n('w', 'wins')}, {r('mp', 'mean_profit')}, {r('sp', 'std_profit')}, {r('w / c', 'win_rate')}, {r('(w / c - 0.524e0) / sqrt(0.524e0 * 0.476e0 / c)', 'z_score')}, {r(_BINOM, 'p_binomial')},
{', '.join(r(_wilson(z, s), f'ci{lv}_{s}') for lv, z in _Z.items() for s in ('low', 'high'))}"""


@query("significance", f"""WITH {B_SQL}, a AS (SELECT season, CAST(count(*) AS BIGINT) AS c, CAST(count(*) FILTER (bet_correct) AS BIGINT) AS w, avg(profit) AS mp, stddev_samp(profit) AS sp FROM b WHERE has_line GROUP BY 1)
SELECT season, {_SIG} FROM a""")
def significance(t):
    return PF.significance(bets(t), "season", t_test=False)


# The t distribution by Simpson's rule on its density; the quantile by bisection on that.
_PDF = "exp(lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5e0 * ln(nu * pi()) - (nu + 1) / 2 * ln(1 + {x} * {x} / nu))"


def _area(x):
    node = _PDF.format(x=f"({x} * i / 2000e0)")
    return f"({x} / 6000e0 * list_sum(list_transform(range(0, 2001), lambda i: {node} * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)))"


@query("significance_t_test", f"""WITH RECURSIVE {B_SQL}, a AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(count(*) FILTER (bet_correct) AS BIGINT) AS w, avg(profit) AS mp, stddev_samp(profit) AS sp,
  CAST(count(*) - 1 AS DOUBLE) AS nu FROM b WHERE has_line), tq AS (SELECT 0e0 AS lo, 20e0 AS hi, 0 AS k, nu FROM a UNION ALL
  SELECT CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, k + 1, nu FROM (SELECT *, 0.5e0 + {_area('mid')} < 0.975e0 AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM tq)) WHERE k < 60),
z AS (SELECT a.*, mp / (sp / sqrt(c)) AS ts, (SELECT (lo + hi) / 2 FROM tq WHERE k = 60) AS q FROM a)
SELECT {_SIG}, {r('ts', 't_stat')}, {r('1 - 2 * ' + _area('abs(ts)'), 'p_t')}, {r('mp - q * sp / sqrt(c)', 'profit_ci_low')}, {r('mp + q * sp / sqrt(c)', 'profit_ci_high')} FROM z""")
def significance_t_test(t):
    return PF.significance(bets(t))


@query("profit_shape", f"""WITH {B_SQL}, a AS (SELECT profit AS x, avg(profit) OVER () AS m FROM b WHERE has_line)
SELECT {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5', 'skewness')}, {r('avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3', 'kurtosis')},
{r('min(x)', 'min')}, {r('max(x)', 'max')}, {r('avg(x) / stddev_samp(x)', 'sharpe')} FROM a""")
def profit_shape(t):
    return PF.profit_shape(bets(t))


@query("kelly_summary", f"""WITH {B_SQL}, a AS (SELECT avg(CASE WHEN bet_correct THEN 1e0 ELSE 0e0 END) AS p FROM b WHERE has_line), k AS (SELECT p, (0.909e0 * p - (1 - p)) / 0.909e0 AS f FROM a)
SELECT {r('p', 'win_rate')}, {r('f', 'kelly_fraction')}, {r('p * ln(1 + 0.909e0 * f) + (1 - p) * ln(1 - f)', 'growth_rate')} FROM k""")
def kelly_summary(t):
    return PF.kelly_summary(bets(t))


@query("edge_profit_corr", f"WITH {B_SQL} SELECT {r('corr(edge_size, profit)', 'edge_profit_corr')} FROM b WHERE has_line")
def edge_profit_corr(t):
    return PF.edge_profit_corr(bets(t))


@query("player_rate_distribution", f"""WITH {B_SQL}, p2 AS (SELECT o_custkey, count(*) AS c, count(*) FILTER (bet_correct) AS w, count(*) FILTER (bet_correct) / count(*) AS x FROM b WHERE has_line GROUP BY 1)
SELECT {n('count(*)', 'players')}, {r('avg(x)', 'mean_rate')}, {r('stddev_pop(x)', 'std_rate')}, {r('min(x)', 'min_rate')}, {r('max(x)', 'max_rate')}, {n('count(*) FILTER (x = 1)', 'perfect')}, {n('count(*) FILTER (x > 0.9e0)', 'above_90')},
{n('count(*) FILTER (x > 0.524e0)', 'above_break_even')}, {n('count(*) FILTER (x = 1 AND c < 15)', 'perfect_small')}, {r('sum(CASE WHEN x = 1 AND c < 15 THEN c ELSE 0 END) / sum(c)', 'perfect_small_share')}, {r('sum(w) / sum(c)', 'weighted_rate')},
{r('avg(x) FILTER (c < 15)', 'small_sample_rate')}, {r('avg(x) FILTER (c >= 15)', 'large_sample_rate')}, {r('avg(c)', 'mean_games')}, {r('quantile_cont(x, 0.5)', 'median_rate')} FROM p2""")
def player_rate_distribution(t):
    return PF.player_rate_distribution(PF.by_player(bets(t), "o_custkey", 1), hot_rows=t.hot_rows)


_POINTS = """CASE WHEN pb < 0.001 THEN 20 WHEN pb < 0.01 THEN 15 WHEN pb < 0.05 THEN 10 ELSE 0 END AS f1,
  CASE WHEN c >= 5000 THEN 20 WHEN c >= 3000 THEN 15 WHEN c >= 1000 THEN 10 ELSE 5 END AS f2,
  CASE WHEN abs(tr) < 0.03 THEN 20 WHEN abs(tr) < 0.05 THEN 15 WHEN abs(tr) < 0.10 THEN 10 ELSE 5 END AS f3,
  CASE WHEN l95 > 0.574e0 THEN 20 WHEN l95 > 0.524e0 THEN 15 WHEN l90 > 0.524e0 THEN 10 ELSE 5 END AS f4,
  CASE WHEN sh IS NULL THEN 10 WHEN sh > 0.85 THEN 20 WHEN sh > 0.75 THEN 15 WHEN sh > 0.60 THEN 10 ELSE 5 END AS f5"""


_SCORE = f"""WITH {B_SQL}, {_DAYS}, {_ROLL}, {_THIRDS},
a AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(count(*) FILTER (bet_correct) AS BIGINT) AS w FROM b WHERE has_line),
z AS (SELECT c, w, {_BINOM} AS pb, {_wilson(_Z[90], 'low')} AS l90, {_wilson(_Z[95], 'low')} AS l95,
  (SELECT max(CASE WHEN period = 'late' THEN w / c END) - max(CASE WHEN period = 'early' THEN w / c END) FROM th) AS tr,
  (SELECT avg(CASE WHEN rate > 0.524e0 THEN 1e0 WHEN rate IS NOT NULL THEN 0e0 END) FROM rr) AS sh FROM a),
f AS (SELECT *, {_POINTS} FROM z), g AS (SELECT *, f1 + f2 + f3 + f4 + f5 AS score FROM f)"""


@query("sustainability_score", _SCORE + f"""
SELECT {n('c', 'n')}, {r('w / c', 'win_rate')}, {r('pb', 'p_binomial')}, {r('l90', 'ci90_low')}, {r('l95', 'ci95_low')}, {r('tr', 'win_rate_trend')}, {r('sh', 'share_above')},
{n('f1', 'significance_points')}, {n('f2', 'sample_points')}, {n('f3', 'stability_points')}, {n('f4', 'interval_points')}, {n('f5', 'consistency_points')}, {n('score', 'score')},
CASE WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 55 THEN 'FAIR' WHEN score >= 40 THEN 'QUESTIONABLE' ELSE 'POOR' END AS rating FROM g""")
def sustainability_score(t):
    return PF.sustainability_score(bets(t), "o_orderdate")


@query("sustainability_flags", _SCORE + f""", v AS (SELECT *, w / c AS rate, abs(coalesce(tr, 0)) AS mv FROM z),
u AS (SELECT 'win_rate' AS "check", CASE WHEN rate > 0.85 THEN 'red' WHEN rate > 0.75 THEN 'warning' ELSE 'good' END AS level, rate AS x FROM v
UNION ALL SELECT 'sample_size', CASE WHEN c < 1000 THEN 'red' WHEN c < 3000 THEN 'warning' ELSE 'good' END, c FROM v
UNION ALL SELECT 'stability', CASE WHEN mv > 0.10 THEN 'red' WHEN mv > 0.05 THEN 'warning' ELSE 'good' END, mv FROM v
UNION ALL SELECT 'interval', CASE WHEN l95 < 0.524 THEN 'red' WHEN l90 < 0.524 THEN 'warning' ELSE 'good' END, l95 FROM v
UNION ALL SELECT 'consistency', CASE WHEN sh < 0.60 THEN 'red' WHEN sh < 0.75 THEN 'warning' ELSE 'good' END, sh FROM v WHERE sh IS NOT NULL)
SELECT "check", level, {r('x', 'value')} FROM u""")
def sustainability_flags(t):
    return PF.sustainability_flags(PF.sustainability_score(bets(t), "o_orderdate"))


_EB = "eb AS (SELECT edge_over AS e, actual > line AS hit FROM pb)"


@query("edge_bins", f"""WITH {PB_SQL}, {_EB}, q AS (SELECT quantile_cont(e, [0.2, 0.4, 0.6, 0.8]) AS q FROM eb),
k AS (SELECT e, hit, list_sum(list_transform(q, lambda x: CASE WHEN x < e THEN 1 ELSE 0 END)) AS bin FROM eb, q),
g AS (SELECT bin, count(*) AS c, avg(e) AS m, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS w FROM k GROUP BY 1), h AS (SELECT *, coalesce(w >= lag(w) OVER (ORDER BY bin), true) AS up FROM g)
SELECT {n('bin', 'bin')}, {n('c', 'n')}, {r('m', 'mean_edge')}, {r('w', 'win_rate')}, bool_and(up) OVER () AS is_monotonic FROM h""")
def edge_bins(t):
    rows = prob_bets(t).withColumn("hit", F.col("actual") > F.col("line"))
    return PF.edge_bins(rows, "edge_over", "hit", hot_rows=t.hot_rows)


@query("edge_bins_equal_width", f"""WITH {PB_SQL}, {_EB}, l AS (SELECT min(e) AS lo, max(e) AS hi FROM eb),
k AS (SELECT e, hit, greatest(least(ceil((e - lo) / (hi - lo) * 5) - 1, 4), 0) AS bin FROM eb, l),
g AS (SELECT bin, count(*) AS c, avg(e) AS m, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS w FROM k GROUP BY 1), h AS (SELECT *, coalesce(w >= lag(w) OVER (ORDER BY bin), true) AS up FROM g)
SELECT {n('bin', 'bin')}, {n('c', 'n')}, {r('m', 'mean_edge')}, {r('w', 'win_rate')}, bool_and(up) OVER () AS is_monotonic FROM h""")
def edge_bins_equal_width(t):
    rows = prob_bets(t).withColumn("hit", F.col("actual") > F.col("line"))
    return PF.edge_bins(rows, "edge_over", "hit", quantiles=False)


@query("bet_distribution", f"""WITH {PB_SQL}, x AS (SELECT *, CASE WHEN should_bet_over THEN edge_over ELSE edge_under END AS e, CASE WHEN should_bet_over THEN bet_size_over ELSE bet_size_under END AS z FROM pb WHERE should_bet_over OR should_bet_under)
SELECT {n('count(*)', 'n_bets')}, {n('count(*) FILTER (should_bet_over)', 'n_over')}, {n('count(*) FILTER (should_bet_under)', 'n_under')}, {r('avg(e)', 'avg_edge')}, {r('min(e)', 'min_edge')}, {r('max(e)', 'max_edge')},
{r('avg(z)', 'avg_bet_size')}, {r('avg(confidence_score)', 'avg_confidence')}, {r('avg(cv)', 'avg_cv')}, {r('quantile_cont(e, 0.5)', 'median_edge')}, {r('quantile_cont(z, 0.5)', 'median_bet_size')} FROM x""")
def bet_distribution(t):
    return PF.bet_distribution(prob_bets(t), t.hot_rows)


@query("strategy_compare", f"""WITH {PB_SQL}, x AS (SELECT *, should_bet_over OR should_bet_under AS made, CASE WHEN should_bet_over THEN actual > line ELSE actual <= line END AS good FROM pb)
SELECT {n('count(*)', 'original_n_bets')}, {r('avg(CASE WHEN bet_correct THEN 1e0 ELSE 0e0 END)', 'original_win_rate')}, {r('avg(profit) * 100', 'original_roi')}, {n('count(*) FILTER (made)', 'prob_n_bets')},
{r('avg(CASE WHEN good THEN 1e0 ELSE 0e0 END) FILTER (made)', 'prob_win_rate')}, {r('avg(CASE WHEN good THEN 0.909e0 ELSE -1e0 END) FILTER (made) * 100', 'prob_roi')} FROM x""")
def strategy_compare(t):
    return PF.strategy_compare(prob_bets(t), "actual", "line")


_EQ = f"""x AS (SELECT *, season AS strategy, CASE WHEN should_bet_over THEN bet_size_over ELSE bet_size_under END * 0.02e0 AS f, CASE WHEN should_bet_over THEN actual > line ELSE actual <= line END AS won
  FROM pb WHERE should_bet_over OR should_bet_under),
eq AS (SELECT *, 1000 * exp(sum(ln(1 + f * CASE WHEN won THEN 100e0 / 110e0 ELSE -1e0 END)) OVER (PARTITION BY strategy ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bankroll FROM x)"""


def equity(t):
    over = F.col("should_bet_over")
    made = prob_bets(t).filter(over | F.col("should_bet_under")).withColumns(
        {
            "strategy": F.col("season"),
            # A fiftieth of the stake keeps the curve readable over thousands of bets.
            "f": F.when(over, F.col("bet_size_over")).otherwise(F.col("bet_size_under")) * 0.02,
            "won": F.when(over, F.col("actual") > F.col("line")).otherwise(F.col("actual") <= F.col("line")),
        }
    )
    keys = Keys("strategy", "o_orderdate", "o_orderkey", hot_rows=t.hot_rows)
    return PF.equity_curve(made, keys, "f", F.col("won"))


@query("equity_curve", f"WITH {PB_SQL}, {_EQ} SELECT strategy, o_orderkey, {r('bankroll', 'bankroll')} FROM eq")
def equity_curve(t):
    return equity(t).select("strategy", "o_orderkey", "bankroll")


@query("equity_summary", f"""WITH {PB_SQL}, {_EQ} SELECT strategy, {n('count(*)', 'n_bets')}, {r('arg_max(bankroll, (o_orderdate, o_orderkey))', 'final_bankroll')}, {r('greatest(max(bankroll), 1000)', 'max_bankroll')},
{r('least(min(bankroll), 1000)', 'min_bankroll')}, {r('(arg_max(bankroll, (o_orderdate, o_orderkey)) - 1000) / 1000 * 100', 'roi')}, {r('1000 - least(min(bankroll), 1000)', 'max_drawdown')} FROM eq GROUP BY 1""")
def equity_summary(t):
    return PF.equity_summary(equity(t), "strategy", "o_orderdate", ["o_orderkey"])


# --- ledger ----------------------------------------------------------------------------------------------

_LEDGER = "lg AS (SELECT o_orderkey, o_custkey AS player_name, CAST(o_orderdate AS DATE) AS bet_date, line AS betting_line, direction, edge, kelly_size, actual AS result FROM best)"


def ledger_rows(t):
    b = best_bets(t).withColumns(
        {"player_name": F.col("o_custkey"), "bet_date": F.to_date("o_orderdate"), "betting_line": F.col("line"), "result": F.col("actual")}
    ).drop("actual")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return L.ledger_entries(b, F.col("bet_date"), stamp, keep="o_orderkey"), b


def results(b):
    """Results of the bets before 2000; later bets stay open. Same-day orders of one customer share the larger."""
    done = b.filter(F.col("bet_date") < F.lit("2000-01-01").cast("date"))
    return done.groupBy("player_name", "bet_date").agg(F.max("result").alias("actual"))


@query("ledger_append", f"""WITH {PB_SQL}, {_BEST_SQL}, {_LEDGER} SELECT o_orderkey, player_name, bet_date, {r('betting_line', 'betting_line')}, direction, {r('edge', 'edge')}, {r('kelly_size', 'kelly_size')},
'pending' AS status, {r('NULL', 'actual')} FROM lg""")
def ledger_append(t):
    from chronoplane.session import work_path

    path = work_path(t.spark, "ledger")
    _, b = ledger_rows(t)
    early = F.col("bet_date") < F.lit("1999-01-01").cast("date")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for part in (b.filter(early), b.filter(~early)):
        L.ledger_append(part, path, F.col("bet_date"), stamp, keep="o_orderkey")
    return t.spark.read.parquet(path).select(
        "o_orderkey", "player_name", "bet_date", "betting_line", "direction", "edge", "kelly_size", "status", "actual"
    )


_SETTLED = """res AS (SELECT player_name, bet_date, max(result) AS a FROM lg WHERE bet_date < DATE '2000-01-01' GROUP BY 1, 2),
st AS (SELECT lg.*, a, CASE WHEN a IS NULL THEN 'pending' WHEN direction = 'OVER' AND a > betting_line THEN 'won' WHEN direction = 'UNDER' AND a <= betting_line THEN 'won' ELSE 'lost' END AS status
  FROM lg LEFT JOIN res USING (player_name, bet_date))"""


@query("ledger_settle", f"WITH {PB_SQL}, {_BEST_SQL}, {_LEDGER}, {_SETTLED} SELECT o_orderkey, player_name, bet_date, status, {r('a', 'actual')} FROM st")
def ledger_settle(t):
    ledger, b = ledger_rows(t)
    return L.ledger_settle(ledger, results(b)).select("o_orderkey", "player_name", "bet_date", "status", "actual")


@query("ledger_summary", f"""WITH {PB_SQL}, {_BEST_SQL}, {_LEDGER}, {_SETTLED}, a AS (SELECT count(*) AS c, count(*) FILTER (status <> 'pending') AS d, count(*) FILTER (status = 'pending') AS pe, count(*) FILTER (status = 'won') AS w,
  count(*) FILTER (status = 'lost') AS l, sum(CASE status WHEN 'won' THEN kelly_size * 0.91e0 WHEN 'lost' THEN -kelly_size END) AS tp, sum(kelly_size) FILTER (status <> 'pending') AS wg, avg(edge) FILTER (status <> 'pending') AS ae, avg(kelly_size) FILTER (status <> 'pending') AS ak FROM st)
SELECT {n('c', 'total_bets')}, {n('d', 'completed_bets')}, {n('pe', 'pending_bets')}, {n('w', 'wins')}, {n('l', 'losses')}, {r('tp', 'total_profit')}, {r('ae', 'avg_edge')}, {r('ak', 'avg_kelly_size')}, {r('w / d', 'win_rate')}, {r('tp / wg * 100', 'roi')} FROM a""")
def ledger_summary(t):
    ledger, b = ledger_rows(t)
    return L.ledger_summary(L.ledger_settle(ledger, results(b)))


