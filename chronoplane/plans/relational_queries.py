"""Queries of the join, set, ordering and profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import absence as A
from chronoplane.operators import history as H
from chronoplane.operators import joins as J
from chronoplane.operators import profile as P
from chronoplane.operators import relational as R
from chronoplane.plans.bindings import (
    CUST_W,
    O_SQL,
    P_SQL,
    SEASON_SQL,
    SEG_SQL,
    event_keys,
    events,
    order_keys,
    orders,
    predictions,
    rows,
    segment_orders,
)
from chronoplane.plans.registry import n, query, r

LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("join_master", f"""WITH {O_SQL}, f AS (SELECT *, avg(v) OVER ({CUST_W} {rows(5)}) AS m5, stddev_samp(v) OVER ({CUST_W} {rows(5)}) AS s5,
  row_number() OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
  date_diff('day', CAST(lag(o_orderdate) OVER ({CUST_W}) AS DATE), CAST(o_orderdate AS DATE)) AS gap FROM o)
SELECT o_orderkey, o_custkey, o_orderdate, season, {r('v', 'v')}, {r('m5', 'v_mean_5')}, {r('s5', 'v_std_5')}, {n('seq', 'games_this_season')}, {n('gap', 'days_since_last')},
{n('coalesce(gap > 7 AND gap <= 30, false)', 'likely_missed')} FROM f""")
def join_master(t):
    o, k = orders(t), order_keys(t)
    tables = [
        H.lag_roll(o, k, "v", (5,)).select(*k.grain, "v_mean_5", "v_std_5"),
        H.season_seq(o, k).select(*k.grain, "games_this_season"),
        A.missed_events(o, k).select(*k.grain, "days_since_last", "likely_missed"),
    ]
    return J.join_master(o.select(*k.grain, "season", "v"), tables, k.grain)


_YEARLY = """y AS (SELECT o_custkey, season, count(*) AS games, avg(v) AS usage FROM o GROUP BY 1, 2)"""


@query("join_prev_season", f"""WITH {O_SQL}, {_YEARLY}, q AS (SELECT o.*, {SEASON_SQL.format(d='(o_orderdate - INTERVAL 1 YEAR)')} AS prev FROM o)
SELECT o_orderkey, {n('games', 'prev_games')}, {r('usage', 'prev_usage')} FROM q LEFT JOIN y ON q.o_custkey = y.o_custkey AND q.prev = y.season""")
def join_prev_season(t):
    o = orders(t)
    ref = o.groupBy("o_custkey", "season").agg(F.count(F.lit(1)).alias("games"), F.avg("v").alias("usage"))
    return J.join_prev_season(o, ref, "o_custkey", "season", "games").select("o_orderkey", "prev_games", "prev_usage")


@query("dedup_max", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_quantity', 'l_quantity')}, {r('l_extendedprice', 'l_extendedprice')} FROM d WHERE k = 1""")
def dedup_max(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return J.dedup_max(li, ["l_orderkey", "l_linenumber"], "l_quantity")


@query("dedup_first", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, {r('l_quantity', 'l_quantity')}, {r('l_extendedprice', 'l_extendedprice')} FROM d WHERE k = 1""")
def dedup_first(t):
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return J.dedup_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


@query("join_baselines", f"""WITH {SEG_SQL}, b AS (SELECT segment, avg(v) AS m FROM so WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT o_orderkey, {r('m', 'v_mean')} FROM so LEFT JOIN b USING (segment)""")
def join_baselines(t):
    so = segment_orders(t)
    train = so.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    b = train.groupBy("segment").agg(F.avg("v").alias("v_mean"))
    return J.join_baselines(so, b, "segment").select("o_orderkey", "v_mean")


# Order lines as quoted odds: key = (customer, day), source = return flag, line = quantity (NULL when taxed 8 %).
_ODDS_SQL = """q AS (SELECT o_custkey, o_orderdate, CASE l_returnflag WHEN 'A' THEN 'FanDuel' WHEN 'N' THEN 'DraftKings' ELSE 'Other' END AS bookmaker,
  CASE WHEN l_tax <> 0.08e0 THEN l_quantity END AS line_q, -100 - l_discount * 100 AS over_price, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_ORDER_SQL = ", ".join(_ORDER)


def quotes(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    book = (
        F.when(F.col("l_returnflag") == "A", "FanDuel").when(F.col("l_returnflag") == "N", "DraftKings").otherwise("Other")
    )
    return t.lineitem.join(o, "l_orderkey").select(
        "o_custkey", "o_orderdate", book.alias("bookmaker"),
        F.when(F.col("l_tax") != 0.08, F.col("l_quantity")).alias("line_q"),
        (-100 - F.col("l_discount") * 100).alias("over_price"), *_ORDER,
    )


_FIRST_SQL = f"""fl AS (SELECT o_custkey, o_orderdate, first(line_q ORDER BY {_ORDER_SQL}) FILTER (line_q IS NOT NULL) AS line_q,
  first(over_price ORDER BY {_ORDER_SQL}) AS over_price FROM q GROUP BY 1, 2)"""


@query("first_line", f"WITH {_ODDS_SQL}, {_FIRST_SQL} SELECT o_custkey, o_orderdate, {r('line_q', 'line_q')}, {r('over_price', 'over_price')} FROM fl")
def first_line(t):
    return J.first_line(quotes(t), ["o_custkey", "o_orderdate"], _ORDER, ["line_q", "over_price"])


@query("join_lines", f"""WITH {P_SQL}, {_ODDS_SQL}, {_FIRST_SQL} SELECT o_orderkey, {r('prediction', 'prediction')}, {r('line_q', 'line_q')}, {r('over_price', 'over_price')},
line_q IS NOT NULL AS has_line FROM p LEFT JOIN fl USING (o_custkey, o_orderdate)""")
def join_lines(t):
    out = J.join_lines(
        predictions(t), quotes(t), ["o_custkey", "o_orderdate"], _ORDER, ["line_q", "over_price"], "line_q"
    )
    return out.select("o_orderkey", "prediction", "line_q", "over_price", "has_line")


@query("join_multi_line", f"""WITH {P_SQL}, {_ODDS_SQL}, g AS (SELECT o_custkey, o_orderdate, bookmaker, max(line_q) AS line_q, CASE WHEN bookmaker <> 'Other' THEN max(over_price) END AS odds FROM q GROUP BY 1, 2, 3)
SELECT o_orderkey, bookmaker, {r('coalesce(line_q, prediction)', 'line_for_prob')}, {r('coalesce(odds, -110)', 'odds')} FROM p LEFT JOIN g USING (o_custkey, o_orderdate)""")
def join_multi_line(t):
    g = quotes(t).groupBy("o_custkey", "o_orderdate", "bookmaker").agg(
        F.max("line_q").alias("line_q"), F.max("over_price").alias("__o")
    )
    g = g.withColumn("odds", F.when(F.col("bookmaker") != "Other", F.col("__o"))).drop("__o")
    out = J.join_multi_line(predictions(t), g, ["o_custkey", "o_orderdate"], "line_q", "odds", "prediction", -110.0)
    return out.select("o_orderkey", "bookmaker", "line_for_prob", "odds")


@query("pick_preferred", f"""WITH {_ODDS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE lower(bookmaker) WHEN 'fanduel' THEN 0 WHEN 'draftkings' THEN 1 END, {_ORDER_SQL}) AS rn
  FROM q WHERE lower(bookmaker) IN ('fanduel', 'draftkings'))
SELECT o_custkey, bookmaker, l_orderkey, l_linenumber, {r('over_price', 'over_price')} FROM k WHERE rn = 1""")
def pick_preferred(t):
    out = J.pick_preferred(quotes(t), "o_custkey", "bookmaker", ["fanduel", "draftkings"], _ORDER)
    return out.select("o_custkey", "bookmaker", "l_orderkey", "l_linenumber", "over_price")


@query("asof_latest", f"""WITH x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS a, CASE WHEN event_type = 'purchase' THEN value END AS b FROM events
  WHERE ts < TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-20'))
SELECT user_id, {r('arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL)', 'a')}, {r('arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL)', 'b')}, max(ts) AS latest_time FROM x GROUP BY 1""")
def asof_latest(t):
    e = events(t).withColumns(
        {
            "a": F.when(F.col("event_type") != "error", F.col("value")),
            "b": F.when(F.col("event_type") == "purchase", F.col("value")),
        }
    )
    day = F.lit("2024-01-20").cast("timestamp_ntz")
    wanted = t.events.filter((F.col("event_type") == "signup") & (F.to_date("ts") == F.lit("2024-01-20").cast("date")))
    return J.asof_latest(e, event_keys(t), ["a", "b"], day, wanted)


@query("asof_join", f"""WITH x AS (SELECT * FROM events WHERE event_type <> 'signup'), y AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup')
SELECT y.event_id, y.user_id, {r('(SELECT arg_max(value, (x.ts, x.event_id)) FROM x WHERE x.user_id = y.user_id AND x.ts < y.ts)', 'value')} FROM y""")
def asof_join(t):
    e = events(t)
    targets = e.filter(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    facts = e.filter(F.col("event_type") != "signup")
    return J.asof_join(targets, facts, event_keys(t), "value").select("event_id", "user_id", "value")


@query("semi_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_in(t):
    wanted = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_in(t.orders.select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query("window_range_join", f"""WITH {SEG_SQL}, d AS (SELECT DISTINCT segment, CAST(o_orderdate AS DATE) AS day FROM so)
SELECT segment, day, {n('''(SELECT count(v) FROM so WHERE so.segment = d.segment AND CAST(o_orderdate AS DATE) >= day - 365 AND CAST(o_orderdate AS DATE) < day)''', 'train_rows')},
{r('''(SELECT avg(v) FROM so WHERE so.segment = d.segment AND CAST(o_orderdate AS DATE) >= day - 365 AND CAST(o_orderdate AS DATE) < day)''', 'train_mean')},
{r('''(SELECT stddev_samp(v) FROM so WHERE so.segment = d.segment AND CAST(o_orderdate AS DATE) >= day - 365 AND CAST(o_orderdate AS DATE) < day)''', 'train_std')} FROM d""")
def window_range_join(t):
    so = segment_orders(t).withColumn("day", F.to_date("o_orderdate"))
    return J.window_range_join(so, "day", so, "day", "v", 365, "segment")


@query("training_window", f"""WITH {O_SQL} SELECT o_orderkey, o_orderdate FROM o WHERE CAST(o_orderdate AS DATE) >= DATE '2000-01-01' - 730 AND CAST(o_orderdate AS DATE) < DATE '2000-01-01'""")
def training_window(t):
    return J.training_window(t.orders, "o_orderdate", "2000-01-01", 2).select("o_orderkey", "o_orderdate")


@query("name_coverage", f"""WITH a AS (SELECT DISTINCT replace(c_name, 'Customer', '') AS k FROM customer), b AS (SELECT DISTINCT replace(s_name, 'Supplier', '') AS k FROM supplier),
c AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT {n('count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)', 'matched')}, {n('count(*) FILTER (y IS NULL)', 'left_only')}, {n('count(*) FILTER (x IS NULL)', 'right_only')},
{r('count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) * 100e0 / count(x)', 'match_rate')} FROM c""")
def name_coverage(t):
    return J.name_coverage(
        t.customer, t.supplier, F.regexp_replace("c_name", "Customer", ""), F.regexp_replace("s_name", "Supplier", "")
    )


# --- sets and order --------------------------------------------------------------------------------------

@query("union_all", "SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def union_all(t):
    return R.union_all(
        t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation")),
    )


@query("intersect_except", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT coalesce(a.k, b.k) AS customer, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def intersect_except(t):
    return R.intersect_except(t.orders.select(F.col("o_custkey").alias("customer")), t.customer.select(F.col("c_custkey").alias("customer")), "customer")


@query("distinct_values", f"WITH {O_SQL} SELECT DISTINCT season FROM o WHERE season >= '1995-96' AND season <= '1999-00'")
def distinct_values(t):
    return R.distinct_values(orders(t), "season", ("1995-96", "1999-00"))


@query("first_per_group", f"""WITH {O_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) AS rn FROM o)
SELECT o_custkey, season, o_orderkey, {r('v', 'v')} FROM k WHERE rn = 1""")
def first_per_group(t):
    return R.first_per_group(orders(t), order_keys(t), "season").select("o_custkey", "season", "o_orderkey", "v")


@query("sort_check", f"""WITH k AS (SELECT user_id, ts < max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM events)
SELECT user_id, {n('count(*)', 'rows')}, {n('sum(CASE WHEN late THEN 1 ELSE 0 END)', 'out_of_order')} FROM k GROUP BY 1""")
def sort_check(t):
    # The value column stands for an ingest sequence that does not follow time.
    e = events(t).withColumn("seq", F.struct("value", "event_id"))
    return R.sort_check(e, event_keys(t), "seq")


# --- profiles --------------------------------------------------------------------------------------------

@query("season_coverage", f"""WITH {O_SQL}, s AS (SELECT season, count(DISTINCT o_orderkey) AS ev, count(DISTINCT o_custkey) AS en, min(o_orderdate) AS a, max(o_orderdate) AS b FROM o GROUP BY 1)
SELECT season, {n('ev', 'events')}, {n('en', 'entities')}, a AS first_time, b AS last_time,
ev < 0.8e0 * CASE season WHEN '1994-95' THEN 1000 ELSE 2400 END AS is_short, month(b) > 6 AS ends_late FROM s""")
def season_coverage(t):
    expected = P.expected_events("season", 2400, {"1994-95": 1000})
    return P.season_coverage(orders(t), "season", "o_orderkey", "o_custkey", "o_orderdate", expected)


@query("events_per_entity", f"""WITH c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1)
SELECT {n('count(*)', 'entities')}, {r('avg(k)', 'mean_rows')}, {n('min(k)', 'min_rows')}, {n('max(k)', 'max_rows')}, {n('count(*) FILTER (k < 5)', 'below_5')},
{n('count(*) FILTER (k < 10)', 'below_10')}, {r('quantile_cont(k, 0.5)', 'median_rows')} FROM c""")
def events_per_entity(t):
    return P.events_per_entity(t.orders, "o_custkey", hot_rows=t.hot_rows)


def _dist_sql(v):
    return f"""{r(f'avg({v})', 'mean')}, {r(f'stddev_samp({v})', 'std')}, {r(f'min({v})', 'min')}, {r(f'max({v})', 'max')}, {r(f'skewness({v})', 'skew')}, {n(f'count({v})', 'n')},
{r(f'quantile_cont({v}, 0.05)', 'q05')}, {r(f'quantile_cont({v}, 0.25)', 'q25')}, {r(f'quantile_cont({v}, 0.5)', 'median')}, {r(f'quantile_cont({v}, 0.75)', 'q75')}, {r(f'quantile_cont({v}, 0.95)', 'q95')}"""


@query("target_distribution", f"SELECT {_dist_sql('value')} FROM events")
def target_distribution(t):
    return P.target_distribution(t.events, "value", hot_rows=t.hot_rows)


@query("target_distribution_by_split", f"""WITH {O_SQL}, s AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1998-10-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-10-01' THEN 'val' ELSE 'test' END AS split FROM o)
SELECT split, {_dist_sql('v')} FROM s GROUP BY 1""")
def target_distribution_by_split(t):
    from chronoplane.operators.splits import chrono_split

    return P.target_distribution(chrono_split(orders(t), "o_orderdate", "1998-10-01", "1999-10-01"), "v", "split", t.hot_rows)


@query("drift_by_season", f"""WITH {O_SQL}, s AS (SELECT season, avg(v) AS m, stddev_samp(v) AS sd, count(v) AS c, quantile_cont(v, 0.5) AS q FROM o GROUP BY 1)
SELECT season, {r('m', 'mean')}, {r('sd', 'std')}, {n('c', 'n')}, {r('q', 'median')}, {r('max(m) OVER () - min(m) OVER ()', 'mean_drift')} FROM s""")
def drift_by_season(t):
    return P.drift_by_season(orders(t), "season", "v", t.hot_rows)


@query("multi_team_seasons", f"""SELECT o_custkey, year(o_orderdate) AS y, {n('count(DISTINCT l_suppkey)', 'num_teams')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1""")
def multi_team_seasons(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("y"))
    return P.multi_team_seasons(t.lineitem.join(o, "l_orderkey"), "o_custkey", "y", F.col("l_suppkey"))


@query("high_variance_entities", f"""WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd, count(value) AS c FROM events GROUP BY 1)
SELECT user_id, {r('m', 'mean')}, {r('sd', 'std')}, {n('c', 'n')}, {r('sd / nullif(m, 0)', 'cv')} FROM s WHERE sd / nullif(m, 0) > 1 AND c >= 20 ORDER BY sd / m DESC, user_id LIMIT 5""")
def high_variance_entities(t):
    return P.high_variance_entities(t.events, "user_id", "value")


@query("cohort_counts", f"""WITH {O_SQL}, f AS (SELECT o_custkey, min(season) AS season FROM o GROUP BY 1) SELECT season, {n('count(*)', 'new_entities')} FROM f GROUP BY 1""")
def cohort_counts(t):
    return P.cohort_counts(orders(t), "o_custkey", "season")


@query("events_per_day", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(DISTINCT o_orderkey) AS k FROM orders GROUP BY 1)
SELECT {n('count(*)', 'days')}, {r('avg(k)', 'mean_events')}, {n('min(k)', 'min_events')}, {n('max(k)', 'max_events')} FROM d""")
def events_per_day(t):
    return P.events_per_day(t.orders, "o_orderdate", "o_orderkey")


@query("conditional_means", f"""WITH g AS (SELECT *, date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS g FROM events)
SELECT {n('count(*) FILTER (g > 2)', 'long_gap_rows')}, {r('avg(value) FILTER (g > 2)', 'mean_after_long_gap')}, {n('count(*) FILTER (g = 1)', 'next_day_rows')},
{r('count(*) FILTER (g = 1) / count(*)', 'next_day_share')}, {r('avg(value) FILTER (g = 1) - avg(value)', 'next_day_diff')}, {r('avg(value)', 'mean_all')},
{r('count(*) FILTER (value < 1) / count(*)', 'zero_share')} FROM g""")
def conditional_means(t):
    return P.conditional_means(events(t), event_keys(t), "value", F.col("value") >= 1, long_gap=2)
