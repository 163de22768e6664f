"""Frames of the test tables that the queries share, each with the SQL of the same rows.

Events of users and orders of customers are the histories; order value (in thousands) is the outcome, its
lagged means are the predictions, and an earlier value rounded to the half is the quoted line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.functions.cleaning import season_label
from chronoplane.keys import Keys
from chronoplane.operators.decisions import bet_decision_point, bet_decision_prob, bet_outcome
from chronoplane.operators.history import rows_before
from chronoplane.operators.probability import gamma_fit, prob_over
from chronoplane.operators.timeline import on_timeline
from chronoplane.plans.registry import Tables
from chronoplane.session import parts_for, stored


def event_keys(t: Tables) -> Keys:
    return Keys("user_id", "ts", "event_id", hot_rows=t.hot_rows)


def order_keys(t: Tables) -> Keys:
    return Keys("o_custkey", "o_orderdate", "o_orderkey", season="season", hot_rows=t.hot_rows)


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", "value")


def orders(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        (F.col("o_totalprice") / 1000).alias("v"),
        season_label("o_orderdate").alias("season"),
        "o_orderstatus",
        "o_orderpriority",
    )


def segment_orders(t: Tables) -> DataFrame:
    """Orders with the customer's market segment."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return orders(t).join(customers, "o_custkey")


def meetings(t: Tables) -> DataFrame:
    """One row per order and supplier nation: the customer meets the nation as its opponent.

    Orders and their items are dealt by order into parts of bounded size, in which they are joined and summed: shuffle
    partitions are as many for a large table as for a small one, and a task's sorts and groups would grow with the table.
    """
    item = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    side = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("opponent"))
    parts = parts_for(t.lineitem)
    return (
        item.join(side, "l_suppkey")
        .repartition(parts, "l_orderkey")
        .join(order.repartition(parts, "l_orderkey"), "l_orderkey")
        .groupBy("o_custkey", F.col("l_orderkey").alias("o_orderkey"), "o_orderdate", "opponent")
        .agg(F.sum("l_quantity").alias("qty"), (F.sum("l_extendedprice") / 1000).alias("price"))
    )


def predictions(t: Tables) -> DataFrame:
    """Per order: actual value, point prediction, predictive mean and variance, and a quoted line.

    Stored, as predictions are in practice: the evaluations that follow read them several times.
    """
    v = F.col("v")
    cols = {
        "prediction": lambda w: F.avg(v).over(rows_before(w, 5)),
        "mean_pred": lambda w: F.avg(v).over(rows_before(w, 20)),
        "__var": lambda w: F.var_samp(v).over(rows_before(w, 20)),
        "line": lambda w: F.floor(F.lag(v, 2).over(w)) + 0.5,
    }
    base = on_timeline(orders(t), order_keys(t), lambda tl: tl.look_back(20, cols), reach=20)
    floor = F.col("mean_pred") * 0.1
    var = F.when(F.col("__var").isNotNull(), F.greatest(F.col("__var"), floor * floor))
    rows = base.select(
        "o_orderkey", "o_custkey", "o_orderdate", "season", F.col("v").alias("actual"), "prediction", "mean_pred",
        var.alias("var_pred"), F.sqrt(var).alias("std_pred"), "line", "o_orderpriority",
    )
    return stored(rows, "predictions")


def scored(t: Tables) -> DataFrame:
    """Predictions with Gamma parameters."""
    return gamma_fit(predictions(t), "mean_pred", "var_pred")


def bets(t: Tables) -> DataFrame:
    """Point decisions and their outcomes."""
    held = predictions(t).filter(F.col("prediction").isNotNull())
    return bet_outcome(bet_decision_point(held, "prediction", "line"), "actual", "line")


def prob_bets(t: Tables) -> DataFrame:
    """Probability decisions beside the point decisions, on rows with a line and a distribution."""
    held = scored(t).filter(F.col("alpha").isNotNull() & F.col("line").isNotNull())
    p = bet_decision_prob(stored(prob_over(held, "line"), "tails"), "prob_over", "std_pred", "mean_pred", max_cv=0.8)
    return bet_outcome(bet_decision_point(p, "prediction", "line"), "actual", "line")


# --- the same frames in SQL ------------------------------------------------------------------------------

SEASON_SQL = (
    "printf('%d-%02d', year({d}) - CASE WHEN month({d}) >= 10 THEN 0 ELSE 1 END, "
    "(year({d}) + CASE WHEN month({d}) >= 10 THEN 1 ELSE 0 END) % 100)"
)
O_SQL = f"""o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice / 1000 AS v,
  {SEASON_SQL.format(d='o_orderdate')} AS season, o_orderstatus, o_orderpriority FROM orders)"""
SEG_SQL = O_SQL + """,
so AS (SELECT o.*, c_mktsegment AS segment FROM o JOIN customer ON o_custkey = c_custkey)"""
MEET_SQL = """m AS (SELECT o_custkey, o_orderkey, o_orderdate, s_nationkey AS opponent,
  sum(l_quantity) AS qty, sum(l_extendedprice) / 1000 AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3, 4)"""
CUST_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
USER_W = "PARTITION BY user_id ORDER BY ts, event_id"


def rows(k: int) -> str:
    return f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING"


P_SQL = O_SQL + f""",
p0 AS (SELECT *, avg(v) OVER ({CUST_W} {rows(5)}) AS prediction, avg(v) OVER ({CUST_W} {rows(20)}) AS mean_pred,
  var_samp(v) OVER ({CUST_W} {rows(20)}) AS vs, floor(lag(v, 2) OVER ({CUST_W})) + 0.5e0 AS line FROM o),
p AS (SELECT o_orderkey, o_custkey, o_orderdate, season, v AS actual, prediction, mean_pred,
  CASE WHEN vs IS NOT NULL THEN greatest(vs, mean_pred * 0.1e0 * (mean_pred * 0.1e0)) END AS var_pred,
  sqrt(CASE WHEN vs IS NOT NULL THEN greatest(vs, mean_pred * 0.1e0 * (mean_pred * 0.1e0)) END) AS std_pred,
  line, o_orderpriority FROM p0)"""
S_SQL = P_SQL + """,
s AS (SELECT *, CASE WHEN var_pred IS NOT NULL THEN greatest(mean_pred * (mean_pred / greatest(var_pred, 0.01e0)), 0.1e0) END AS alpha,
  CASE WHEN var_pred IS NOT NULL THEN greatest(mean_pred / greatest(var_pred, 0.01e0), 0.01e0) END AS beta FROM p)"""
B_SQL = P_SQL + """,
b AS (SELECT *, line IS NOT NULL AS has_line, (coalesce(actual > line, false) = bet_over) AS bet_correct,
  CASE WHEN line IS NULL THEN 0e0 WHEN coalesce(actual > line, false) = bet_over THEN 0.909e0 ELSE -1e0 END AS profit
  FROM (SELECT *, coalesce(prediction > line, false) AS bet_over, abs(prediction - line) AS edge_size
        FROM p WHERE prediction IS NOT NULL))"""


def gamma_cdf_sql(a: str, x: str) -> str:
    """P(a, x) by its power series, with as many terms as the argument needs."""
    return (
        f"least(1e0, list_sum(list_transform(range(0, CAST(ceil({x} + 12 * sqrt({x}) + 80) AS BIGINT)), "
        f"lambda i: exp(-({x}) + (({a}) + i) * ln({x}) - lgamma(({a}) + i + 1)))))"
    )


BREAK_EVEN = "(110e0 / 210e0)"
_KELLY = "CASE WHEN {p} - " + BREAK_EVEN + " >= 0.03e0 THEN least(greatest(({p} * (100e0/110e0) - (1 - {p})) / (100e0/110e0) * 0.25e0, 0e0), 0.25e0) ELSE 0e0 END"
PB_SQL = S_SQL + f""",
pb0 AS (SELECT *, 1 - {gamma_cdf_sql('alpha', 'beta * line')} AS prob_over FROM s WHERE alpha IS NOT NULL AND line IS NOT NULL),
pb1 AS (SELECT *, 1 - prob_over AS prob_under, prob_over - {BREAK_EVEN} AS edge_over, 1 - prob_over - {BREAK_EVEN} AS edge_under,
  {_KELLY.format(p='prob_over')} AS kelly_size_over, {_KELLY.format(p='(1 - prob_over)')} AS kelly_size_under,
  abs(prob_over - 0.5e0) / 0.5e0 AS confidence_score, std_pred / (mean_pred + 1e-6) AS cv FROM pb0),
pb2 AS (SELECT *, edge_over >= 0.03e0 AND confidence_score >= 0.6e0 AND cv <= 0.8e0 AS should_bet_over,
  edge_under >= 0.03e0 AND confidence_score >= 0.6e0 AND cv <= 0.8e0 AS should_bet_under FROM pb1),
pb AS (SELECT *, CASE WHEN should_bet_over THEN kelly_size_over ELSE 0e0 END AS bet_size_over,
  CASE WHEN should_bet_under THEN kelly_size_under ELSE 0e0 END AS bet_size_under,
  true AS has_line, prediction > line AS bet_over, abs(prediction - line) AS edge_size,
  (actual > line) = (prediction > line) AS bet_correct,
  CASE WHEN (actual > line) = (prediction > line) THEN 0.909e0 ELSE -1e0 END AS profit FROM pb2)"""
