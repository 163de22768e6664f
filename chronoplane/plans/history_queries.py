"""Queries of the lagged, absence, opponent and category operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.keys import Keys
from chronoplane.operators import absence as A
from chronoplane.operators import category as C
from chronoplane.operators import history as H
from chronoplane.operators import imputation as I
from chronoplane.operators import master as MA
from chronoplane.operators import matchup as M
from chronoplane.plans.bindings import (
    CUST_W,
    MEET_SQL,
    O_SQL,
    SEG_SQL,
    USER_W,
    event_keys,
    events,
    meetings,
    order_keys,
    orders,
    rows,
    segment_orders,
)
from chronoplane.plans.registry import n, query, r
from chronoplane.session import parts_for, stored

EV = "event_id, user_id, ts"
OR = "o_orderkey, o_custkey, o_orderdate"


def _ev(df, *cols):
    return df.select("event_id", "user_id", "ts", *cols)


def _or(df, *cols):
    return df.select("o_orderkey", "o_custkey", "o_orderdate", *cols)


@query("lag_roll_mean", f"""SELECT {EV}, {', '.join(r(f'avg(value) OVER ({USER_W} {rows(k)})', f'value_mean_{k}') for k in (5, 10, 20))}
FROM events""")
def lag_roll_mean(t):
    return _ev(H.lag_roll_mean(events(t), event_keys(t), "value"), "value_mean_5", "value_mean_10", "value_mean_20")


@query("lag_roll_std", f"""SELECT {EV}, {', '.join(r(f'stddev_samp(value) OVER ({USER_W} {rows(k)})', f'value_std_{k}') for k in (5, 10, 20))}
FROM events""")
def lag_roll_std(t):
    return _ev(H.lag_roll_std(events(t), event_keys(t), "value"), "value_std_5", "value_std_10", "value_std_20")


def _ewma_sql(h):
    w = f"({USER_W.replace('ts, event_id', 'k')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return r(f"sum(x * pow(2e0, k / {h}e0)) OVER {w} / sum(CASE WHEN x IS NOT NULL THEN pow(2e0, k / {h}e0) END) OVER {w}", f"x_ewma_{h}")


@query("lag_ewma", f"""WITH e AS (SELECT *, row_number() OVER ({USER_W}) AS k,
  CASE WHEN event_type <> 'error' THEN value END AS x FROM events)
SELECT {EV}, {', '.join(_ewma_sql(h) for h in (3, 7, 14))} FROM e""")
def lag_ewma(t):
    e = events(t).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return _ev(H.lag_ewma(e, event_keys(t), "x"), "x_ewma_3", "x_ewma_7", "x_ewma_14")


@query("lag_trend", f"""WITH e AS (SELECT *, row_number() OVER ({USER_W}) AS k,
  CASE WHEN event_type <> 'error' THEN value END AS x FROM events)
SELECT {EV}, {r(f"CASE WHEN count(x) OVER w >= 3 THEN regr_slope(x, k) OVER w END", 'x_trend')}
FROM e WINDOW w AS ({USER_W} {rows(10)})""")
def lag_trend(t):
    e = events(t).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return _ev(H.lag_trend(e, event_keys(t), "x"), "x_trend")


@query("lag_split_mean", f"""SELECT {EV}, {r("avg(CASE WHEN event_type = 'click' THEN value END) OVER w", 'value_home_avg')},
{r("avg(CASE WHEN event_type <> 'click' THEN value END) OVER w", 'value_away_avg')}
FROM events WINDOW w AS ({USER_W} {rows(10)})""")
def lag_split_mean(t):
    out = H.lag_split_mean(events(t), event_keys(t), "value", F.col("event_type") == "click")
    return _ev(out, "value_home_avg", "value_away_avg")


@query("season_seq", f"""WITH {O_SQL} SELECT {OR}, season,
{n("row_number() OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) - 1", 'games_this_season')} FROM o""")
def season_seq(t):
    return _or(H.season_seq(orders(t), order_keys(t)), "season", "games_this_season")


@query("gap_days", f"""SELECT {OR}, {n(f"date_diff('day', CAST(lag(o_orderdate) OVER ({CUST_W}) AS DATE), CAST(o_orderdate AS DATE))", 'days_since_last')} FROM orders""")
def gap_days(t):
    return _or(H.gap_days(orders(t), order_keys(t)), "days_since_last")


@query("gap_flags", f"""WITH g AS (SELECT {EV}, coalesce(date_diff('day', CAST(lag(ts) OVER ({USER_W}) AS DATE), CAST(ts AS DATE)), 3) AS d FROM events)
SELECT {EV}, {n('d', 'days_since_last')}, {n('d = 1', 'is_back_to_back')}, {n('d = 2', 'is_one_day_rest')}, {n('d >= 3', 'is_well_rested')} FROM g""")
def gap_flags(t):
    return _ev(
        H.gap_flags(events(t), event_keys(t)), "days_since_last", "is_back_to_back", "is_one_day_rest", "is_well_rested"
    )


def _count_sql(d):
    return n(f"count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING)", f"games_last_{d}_days")


@query("count_last_days", f"""WITH e AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events)
SELECT {EV}, {', '.join(_count_sql(d) for d in (7, 14, 30))} FROM e""")
def count_last_days(t):
    out = H.count_last_days(events(t), event_keys(t))
    return _ev(out, "games_last_7_days", "games_last_14_days", "games_last_30_days")


@query("availability", f"""WITH e AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS g FROM e)
SELECT {EV}, {n('g', 'games_played_last_30_days')}, {r('least(100e0, g / 12e0 * 100)', 'availability_score')} FROM c""")
def availability(t):
    return _ev(H.availability(events(t), event_keys(t)), "games_played_last_30_days", "availability_score")


@query("form_flags", f"""WITH {O_SQL}, f AS (SELECT *, lag(v) OVER ({CUST_W}) AS l1, avg(v) OVER ({CUST_W} {rows(3)}) AS l3,
  avg(v) OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sm FROM o)
SELECT {OR}, {n('coalesce(l1 > sm, false)', 'last_game_above_avg')}, {n('coalesce(l3 > sm * 1.1e0, false)', 'hot_last_3_games')},
{n('coalesce(l3 < sm * 0.9e0, false)', 'cold_last_3_games')} FROM f""")
def form_flags(t):
    out = H.form_flags(orders(t), order_keys(t), "v")
    return _or(out, "last_game_above_avg", "hot_last_3_games", "cold_last_3_games")


@query("minutes_context", f"""SELECT {EV}, {r(f'lag(value) OVER ({USER_W})', 'minutes_last_game')}, {r(f'avg(value) OVER w', 'minutes_avg_last5')},
{r('stddev_samp(value) OVER w', 'minutes_std_last5')}, {n('coalesce(avg(value) OVER w >= 28, false)', 'is_high_minutes')},
{n('coalesce(avg(value) OVER w < 20, false)', 'is_low_minutes')} FROM events WINDOW w AS ({USER_W} {rows(5)})""")
def minutes_context(t):
    out = H.minutes_context(events(t), event_keys(t), "value")
    return _ev(out, "minutes_last_game", "minutes_avg_last5", "minutes_std_last5", "is_high_minutes", "is_low_minutes")


_GAP = f"date_diff('day', CAST(lag(o_orderdate) OVER ({CUST_W}) AS DATE), CAST(o_orderdate AS DATE))"


@query("missed_events", f"""WITH g AS (SELECT *, {_GAP} AS d FROM orders)
SELECT {OR}, {n('d', 'days_since_last')}, {n('coalesce(d > 7 AND d <= 30, false)', 'likely_missed')},
{r('CASE WHEN d > 7 AND d <= 30 THEN greatest((d - 3) * 0.5e0, 0) ELSE 0 END', 'estimated_missed')} FROM g""")
def missed_events(t):
    return _or(A.missed_events(orders(t), order_keys(t)), "days_since_last", "likely_missed", "estimated_missed")


@query("events_since_reset", f"""WITH g AS (SELECT *, {_GAP} AS d FROM orders),
s AS (SELECT *, sum(CASE WHEN d > 10 THEN 1 ELSE 0 END) OVER ({CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM g),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, seg ORDER BY o_orderdate, o_orderkey) - 1 AS c FROM s)
SELECT {OR}, {n('c', 'games_since_reset')}, {n('c > 0 AND c <= 5', 'is_returning')}, {n('c > 0 AND c <= 2', 'is_early_return')} FROM c""")
def events_since_reset(t):
    return _or(A.events_since_reset(orders(t), order_keys(t)), "games_since_reset", "is_returning", "is_early_return")


@query("dnp_patterns", f"""WITH e AS (SELECT *, CASE WHEN value < 3 THEN 1 ELSE 0 END AS np FROM events),
s AS (SELECT *, avg(np) OVER ({USER_W} {rows(30)}) AS rate,
  sum(np) OVER ({USER_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM e),
c AS (SELECT *, sum(1 - np) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s)
SELECT {EV}, {n('np', 'is_dnp')}, {r('rate', 'dnp_rate')}, {n('coalesce(rate > 0.15e0 AND value > 0, false)', 'likely_rested')},
{n('run', 'consecutive_played')} FROM c""")
def dnp_patterns(t):
    out = A.dnp_patterns(events(t), event_keys(t), "value")
    return _ev(out, "is_dnp", "dnp_rate", "likely_rested", "consecutive_played")


@query("dnp_patterns_lagged", f"""WITH e AS (SELECT *, CASE WHEN value < 3 THEN 1 ELSE 0 END AS np,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
s AS (SELECT *, sum(np) OVER ({USER_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
  avg(np) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rate FROM e),
c AS (SELECT *, sum(1 - np) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s)
SELECT {EV}, {n(f'lag(np) OVER ({USER_W})', 'is_dnp_prev')}, {n(f'lag(run) OVER ({USER_W})', 'consecutive_played_prev')},
{r('rate', 'dnp_rate')}, {n('coalesce(rate > 0.15e0 AND value > 0, false)', 'likely_rested')} FROM c""")
def dnp_patterns_lagged(t):
    out = A.dnp_patterns(events(t), event_keys(t), "value", rows=None, days=7, lag=True)
    return _ev(out, "is_dnp_prev", "consecutive_played_prev", "dnp_rate", "likely_rested")


@query("recovery", f"""WITH {O_SQL}, e AS (SELECT *, CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END AS ex,
  (lag(v, 1) OVER ({CUST_W}) - lag(v, 3) OVER ({CUST_W})) / 3 AS ramp FROM o WINDOW w AS ({CUST_W} {rows(10)})),
f AS (SELECT *, CASE WHEN v < ex * 0.8e0 THEN 1 ELSE 0 END AS low FROM e),
s AS (SELECT *, sum(1 - low) OVER ({CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM f),
c AS (SELECT *, sum(low) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s)
SELECT {OR}, {r('CASE WHEN ex IS NOT NULL THEN greatest(ex - v, 0) END', 'minutes_deficit')}, {n('coalesce(ramp > 2, false)', 'is_ramping_up')},
{n('run', 'restriction_run')}, {n('run >= 2', 'is_restricted')} FROM c""")
def recovery(t):
    out = A.recovery(orders(t), order_keys(t), "v")
    return _or(out, "minutes_deficit", "is_ramping_up", "restriction_run", "is_restricted")


@query("seasons_available", f"""WITH {O_SQL}, e AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN v END AS x FROM o)
SELECT {OR}, {n(f'count(x) OVER ({CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'seasons_available')},
{n('''(SELECT count(DISTINCT q.season) FROM e q WHERE q.o_custkey = e.o_custkey AND q.season < e.season AND q.x IS NOT NULL)''', 'distinct_seasons')} FROM e""")
def seasons_available(t):
    o = orders(t).withColumn("x", F.when(F.col("o_orderstatus") != "P", F.col("v")))
    k = order_keys(t)
    counted = H.seasons_available(o, k, "x")
    return _or(
        H.seasons_available(counted, k, "x", "distinct_seasons", distinct_seasons=True),
        "seasons_available",
        "distinct_seasons",
    )


@query("quality_score", f"""WITH {O_SQL}, e AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN v END AS x FROM o),
h AS (SELECT *, count(x) OVER ({CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM e)
SELECT {OR}, {n('x IS NOT NULL', 'has_value')}, {n('c = 0', 'is_first')}, {n('c', 'history_rows')},
{r('CASE WHEN x IS NULL THEN 0 ELSE least(c / 5e0, 1) END', 'data_quality')} FROM h""")
def quality_score(t):
    o = orders(t).withColumn("x", F.when(F.col("o_orderstatus") != "P", F.col("v")))
    return _or(I.quality_score(o, order_keys(t), "x"), "has_value", "is_first", "history_rows", "data_quality")


@query("mid_series_row", f"""WITH {O_SQL}, f AS (SELECT *, row_number() OVER ({CUST_W}) AS k, avg(v) OVER ({CUST_W} {rows(5)}) AS m5,
  avg(CASE WHEN o_orderstatus = 'F' THEN v END) OVER ({CUST_W} {rows(5)}) AS f5 FROM o),
g AS (SELECT count(*) AS c, sum(CASE WHEN m5 IS NULL THEN 1 ELSE 0 END) AS a, sum(CASE WHEN f5 IS NULL THEN 1 ELSE 0 END) AS b FROM f WHERE k = 9)
SELECT 'm5' AS feature, {n('c', 'n_entities')}, {n('a', 'n_empty')}, {r('a / nullif(c, 0)', 'empty_share')} FROM g UNION ALL
SELECT 'f5', CAST(c AS BIGINT), CAST(b AS BIGINT), {r('b / nullif(c, 0)', 'e')} FROM g""")
def mid_series_row(t):
    o, k = orders(t).withColumn("f", F.when(F.col("o_orderstatus") == "F", F.col("v"))), order_keys(t)
    rolled = H.lag_roll_mean(o, k, ("v", "f"), (5,)).withColumnsRenamed({"v_mean_5": "m5", "f_mean_5": "f5"})
    return H.mid_series_row(rolled, k, ("m5", "f5"), position=8)


@query("rolling_table", f"""WITH e AS (SELECT *, row_number() OVER ({USER_W}) AS k, value AS x FROM events)
SELECT {EV}, {', '.join(r(f'avg(x) OVER ({USER_W} {rows(k)})', f'x_mean_{k}') + ', ' + r(f'stddev_samp(x) OVER ({USER_W} {rows(k)})', f'x_std_{k}') for k in (5, 10, 20))},
{r(f"CASE WHEN count(x) OVER w >= 3 THEN regr_slope(x, k) OVER w END", 'x_trend')},
{r("avg(CASE WHEN event_type = 'click' THEN x END) OVER w", 'x_home_avg')}, {r("avg(CASE WHEN event_type <> 'click' THEN x END) OVER w", 'x_away_avg')},
{', '.join(_ewma_sql(h) for h in (3, 7, 14))} FROM e WINDOW w AS ({USER_W} {rows(10)})""")
def rolling_table(t):
    e = events(t).withColumn("x", F.col("value"))
    out = H.rolling_table(e, event_keys(t), "x", F.col("event_type") == "click")
    return _ev(out, *[c for c in out.columns if c.startswith("x_")])


# --- opponents -------------------------------------------------------------------------------------------

@query("team_event_totals", f"""WITH {MEET_SQL} SELECT opponent, o_orderdate, {r('sum(qty)', 'qty')}, {r('sum(price)', 'price')} FROM m GROUP BY 1, 2""")
def team_event_totals(t):
    return M.team_event_totals(meetings(t), ["opponent", "o_orderdate"], ["qty", "price"])


_OPP = "PARTITION BY opponent ORDER BY o_orderdate, o_orderkey"


@query("opp_form", f"""WITH {MEET_SQL} SELECT opponent, o_orderkey, o_orderdate,
{r(f'avg(qty) OVER ({_OPP} {rows(10)})', 'opp_qty_allowed_avg')}, {r(f'avg(price) OVER ({_OPP} {rows(10)})', 'opp_price_allowed_avg')} FROM m""")
def opp_form(t):
    return M.opp_form(meetings(t), "opponent", "o_orderkey", "o_orderdate", ["qty", "price"], hot_rows=t.hot_rows)


@query("join_opponent_form", f"""WITH {MEET_SQL} SELECT o_custkey, opponent, o_orderkey,
{r(f'avg(qty) OVER ({_OPP} {rows(10)})', 'opp_qty_allowed_avg')} FROM m""")
def join_opponent_form(t):
    m = stored(meetings(t), "meetings")
    parts = parts_for(m)
    form = M.opp_form(m.repartition(parts, "o_orderkey"), "opponent", "o_orderkey", "o_orderdate", ["qty"], hot_rows=t.hot_rows)
    return M.join_opponent_form(m, form, "opponent", "o_orderkey", parts).select(
        "o_custkey", "opponent", "o_orderkey", "opp_qty_allowed_avg"
    )


_PACE_SQL = f"""d AS (SELECT opponent, o_orderdate, sum(qty) AS q FROM m GROUP BY 1, 2),
pace AS (SELECT opponent, o_orderdate, avg(q) OVER (PARTITION BY opponent ORDER BY o_orderdate {rows(10)}) AS opp_pace FROM d)"""


@query("opp_pace", f"WITH {MEET_SQL}, {_PACE_SQL} SELECT opponent, o_orderdate, {r('opp_pace', 'opp_pace')} FROM pace")
def opp_pace(t):
    return M.opp_pace(meetings(t), "opponent", "o_orderdate", "qty", hot_rows=t.hot_rows)


@query("join_opponent_pace", f"""WITH {MEET_SQL}, {_PACE_SQL} SELECT m.o_custkey, m.o_orderkey, m.opponent, {r('opp_pace', 'opp_pace')}
FROM m LEFT JOIN pace USING (opponent, o_orderdate)""")
def join_opponent_pace(t):
    m = meetings(t)
    pace = M.opp_pace(m, "opponent", "o_orderdate", "qty", hot_rows=t.hot_rows)
    return M.join_opponent_pace(m, pace, "opponent", "o_orderdate").select(
        "o_custkey", "o_orderkey", "opponent", "opp_pace"
    )


@query("head_to_head", f"""WITH {MEET_SQL} SELECT o_custkey, opponent, o_orderkey, {r(f'avg(qty) OVER (w {rows(5)})', 'qty_vs_opp')},
{r(f'avg(price) OVER (w {rows(5)})', 'price_vs_opp')}, {n('row_number() OVER w - 1', 'games_vs_opp')}
FROM m WINDOW w AS (PARTITION BY o_custkey, opponent ORDER BY o_orderdate, o_orderkey)""")
def head_to_head(t):
    out = M.head_to_head(meetings(t), order_keys(t), "opponent", ["qty", "price"])
    return out.select("o_custkey", "opponent", "o_orderkey", "qty_vs_opp", "price_vs_opp", "games_vs_opp")


_TEAM_SQL = f"""w AS (SELECT o.*, c_nationkey AS team FROM orders o JOIN customer ON o_custkey = c_custkey),
d AS (SELECT team, o_orderdate, arg_min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey) AS win FROM w GROUP BY 1, 2),
form AS (SELECT team, o_orderdate, avg(win) OVER (PARTITION BY team ORDER BY o_orderdate {rows(10)}) AS team_win_rate FROM d)"""


def _team(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    return t.orders.join(c, "o_custkey")


@query("team_form", f"WITH {_TEAM_SQL} SELECT team, o_orderdate, {r('team_win_rate', 'team_win_rate')} FROM form")
def team_form(t):
    return M.team_form(_team(t), "team", "o_orderdate", F.col("o_orderstatus") == "F", "o_orderkey", hot_rows=t.hot_rows)


@query("join_team_form", f"""WITH {_TEAM_SQL} SELECT o_orderkey, o_custkey, team, {r('team_win_rate', 'team_win_rate')}
FROM w LEFT JOIN form USING (team, o_orderdate)""")
def join_team_form(t):
    w = _team(t)
    form = M.team_form(w, "team", "o_orderdate", F.col("o_orderstatus") == "F", "o_orderkey", hot_rows=t.hot_rows)
    return M.join_team_form(w, form, "team", "o_orderdate").select("o_orderkey", "o_custkey", "team", "team_win_rate")


# --- categories ------------------------------------------------------------------------------------------

_SEG_W = "PARTITION BY segment ORDER BY o_orderdate, o_custkey, o_orderkey"
_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("group_z", f"""WITH {SEG_SQL}, g AS (SELECT *, lag(v) OVER ({CUST_W}) AS pv, avg(v) OVER ({_SEG_W} {_PRIOR}) AS gm,
  stddev_samp(v) OVER ({_SEG_W} {_PRIOR}) AS gs FROM so)
SELECT {OR}, {r('(pv - gm) / nullif(gs, 0)', 'v_z')}, {r('pv - gm', 'v_diff')} FROM g""")
def group_z(t):
    return _or(C.group_z(segment_orders(t), order_keys(t), "segment", "v"), "v_z", "v_diff")


@query("expanding_percentile", f"""WITH {SEG_SQL}, x AS (SELECT *, avg(v) OVER ({CUST_W} {rows(5)}) AS form FROM so),
k AS (SELECT *, row_number() OVER ({_SEG_W}) AS k FROM x),
c AS (SELECT a.o_orderkey, a.o_custkey, a.o_orderdate, count(b.form) AS seen, sum(CASE WHEN b.form < a.form THEN 1 ELSE 0 END) AS below
  FROM k a LEFT JOIN k b ON a.segment = b.segment AND b.k < a.k AND a.form IS NOT NULL GROUP BY 1, 2, 3)
SELECT {OR}, {r('CASE WHEN seen > 0 THEN below * 100e0 / seen ELSE 50 END', 'percentile')} FROM c""")
def expanding_percentile(t):
    k = order_keys(t)
    form = H.lag_roll_mean(segment_orders(t), k, "v", (5,)).withColumn("form", F.round("v_mean_5", 9))
    return _or(C.expanding_percentile(form, k, "segment", "form"), "percentile")


_PROF = """prof AS (SELECT o_custkey AS e, l_orderkey, o_orderdate, sum(l_quantity) / 10 AS reb, count(*) AS ast, sum(l_discount) * 10 AS fg3, sum(l_tax) * 50 + 1 AS fga
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
_RULE = """CASE WHEN reb * 0.8e0 - ast * 0.3e0 - coalesce(fg3 / nullif(fga, 0), 0) * 5 > 3 THEN 'Center'
  WHEN reb * 0.8e0 - ast * 0.3e0 - coalesce(fg3 / nullif(fga, 0), 0) * 5 > 1 THEN 'Forward'
  WHEN ast * 0.5e0 + coalesce(fg3 / nullif(fga, 0), 0) * 10 - reb * 0.3e0 > 2 THEN 'Guard' ELSE 'Wing' END"""


def profiles(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("e"), "o_orderdate")
    return t.lineitem.join(o, "l_orderkey").groupBy("e", "l_orderkey", "o_orderdate").agg(
        (F.sum("l_quantity") / 10).alias("reb"),
        F.count(F.lit(1)).alias("ast"),
        (F.sum("l_discount") * 10).alias("fg3"),
        (F.sum("l_tax") * 50 + 1).alias("fga"),
    )


@query("entity_profile", f"""WITH {_PROF}, a AS (SELECT e, avg(reb) AS reb, avg(ast) AS ast, avg(fg3) AS fg3, avg(fga) AS fga FROM prof GROUP BY 1),
c AS (SELECT e, {_RULE} AS position FROM a) SELECT prof.e, l_orderkey, position FROM prof JOIN c USING (e)""")
def entity_profile(t):
    k = Keys("e", "o_orderdate", "l_orderkey", hot_rows=t.hot_rows)
    return C.entity_profile(profiles(t), k, "reb", "ast", "fg3", "fga", as_of=False).select("e", "l_orderkey", "position")


@query("entity_profile_as_of", f"""WITH {_PROF}, a AS (SELECT e, l_orderkey, avg(reb) OVER w AS reb, avg(ast) OVER w AS ast, avg(fg3) OVER w AS fg3, avg(fga) OVER w AS fga
  FROM prof WINDOW w AS (PARTITION BY e ORDER BY o_orderdate, l_orderkey {_PRIOR}))
SELECT e, l_orderkey, {_RULE} AS position FROM a""")
def entity_profile_as_of(t):
    k = Keys("e", "o_orderdate", "l_orderkey", hot_rows=t.hot_rows)
    return C.entity_profile(profiles(t), k, "reb", "ast", "fg3", "fga").select("e", "l_orderkey", "position")


_UR = f"{CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("entity_features", f"""WITH {O_SQL}, e AS (SELECT *, row_number() OVER ({CUST_W}) AS k, {_GAP} AS d, CASE WHEN v < 3 THEN 1 ELSE 0 END AS np,
  CASE WHEN count(v) OVER w10 >= 3 THEN avg(v) OVER w10 END AS ex, avg(v) OVER ({CUST_W} {rows(3)}) AS l3, lag(v) OVER ({CUST_W}) AS l1,
  avg(v) OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey {_PRIOR}) AS sm FROM o WINDOW w10 AS ({CUST_W} {rows(10)})),
f AS (SELECT *, CASE WHEN v < ex * 0.8e0 THEN 1 ELSE 0 END AS low, sum(CASE WHEN d > 10 THEN 1 ELSE 0 END) OVER ({_UR}) AS s1, sum(np) OVER ({_UR}) AS s2 FROM e),
g AS (SELECT *, sum(1 - low) OVER ({_UR}) AS s3, row_number() OVER (PARTITION BY o_custkey, s1 ORDER BY o_orderdate, o_orderkey) - 1 AS c1,
  sum(1 - np) OVER (PARTITION BY o_custkey, s2 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
h AS (SELECT *, sum(low) OVER (PARTITION BY o_custkey, s3 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowrun,
  CASE WHEN ex IS NOT NULL THEN greatest(ex - v, 0) END AS deficit FROM g)
SELECT {OR}, {r('avg(v) OVER w5', 'v_mean_5')}, {r(f'stddev_samp(v) OVER ({CUST_W} {rows(20)})', 'v_std_20')},
{r('CASE WHEN count(v) OVER w10 >= 3 THEN regr_slope(v, k) OVER w10 END', 'v_trend')}, {r("avg(CASE WHEN o_orderstatus = 'F' THEN v END) OVER w10", 'v_home_avg')},
{n('coalesce(d, 3)', 'days_since_last')}, {n('coalesce(d, 3) >= 3', 'is_well_rested')}, {n('coalesce(d > 7 AND d <= 30, false)', 'likely_missed')},
{n('c1', 'games_since_reset')}, {n(f'lag(np) OVER ({CUST_W})', 'is_dnp_prev')}, {n(f'lag(run) OVER ({CUST_W})', 'consecutive_played_prev')},
{r(f'lag(deficit) OVER ({CUST_W})', 'minutes_deficit_prev')}, {n(f'lag(lowrun) OVER ({CUST_W})', 'restriction_run_prev')}, {r('avg(v) OVER w5', 'minutes_avg_last5')},
{r(f'sum(v * pow(2e0, k / 7e0)) OVER ({CUST_W} {_PRIOR}) / sum(pow(2e0, k / 7e0)) OVER ({CUST_W} {_PRIOR})', 'v_ewma_7')},
{n('row_number() OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) - 1', 'games_this_season')}, {n('coalesce(l1 > sm, false)', 'last_game_above_avg')}
FROM h WINDOW w5 AS ({CUST_W} {rows(5)}), w10 AS ({CUST_W} {rows(10)})""")
def entity_features(t):
    out = MA.entity_features(orders(t), order_keys(t), "v", "v", "v", F.col("o_orderstatus") == "F")
    return _or(
        out, "v_mean_5", "v_std_20", "v_trend", "v_home_avg", "days_since_last", "is_well_rested", "likely_missed",
        "games_since_reset", "is_dnp_prev", "consecutive_played_prev", "minutes_deficit_prev", "restriction_run_prev",
        "minutes_avg_last5", "v_ewma_7", "games_this_season", "last_game_above_avg",
    )
