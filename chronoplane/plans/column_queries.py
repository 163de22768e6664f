"""Queries of the scan-side column operators. Raw-looking text is made by Spark from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.functions import cleaning as K
from chronoplane.functions import odds as O
from chronoplane.operators import category as C
from chronoplane.operators import history as H
from chronoplane.plans.bindings import (
    CUST_W,
    O_SQL,
    SEASON_SQL,
    SEG_SQL,
    event_keys,
    events,
    order_keys,
    orders,
    rows,
    segment_orders,
)
from chronoplane.plans.registry import n, query, r


@query("standardise_columns", "SELECT o_orderkey AS game_id, o_custkey AS player_id, o_orderdate AS game_date FROM orders")
def standardise_columns(t):
    names = {"o_orderkey": "game_id", "o_custkey": "player_id", "o_orderdate": "game_date", "absent": "nothing"}
    return K.standardise_columns(t.orders, names)


@query("base_projection", f"WITH {O_SQL} SELECT o_custkey, o_orderkey, o_orderdate, {r('v', 'v')}, season FROM o")
def base_projection(t):
    return K.base_projection(orders(t), order_keys(t).grain, ("v", "season", "player_name"))


# p_size:p_partkey mod 60 as MM:SS, with a plain number, an empty and a broken text among them.
_DUR = """CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS VARCHAR) WHEN p_type = 'STANDARD' THEN 'DNP'
  WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS VARCHAR) || ':' || CAST(p_partkey % 60 AS VARCHAR) END"""


def durations(t):
    size = F.col("p_size").cast("string")
    clock = F.concat(size, F.lit(":"), (F.col("p_partkey") % 60).cast("string"))
    text = (
        F.when(F.col("p_type") == "ECONOMY", size)
        .when(F.col("p_type") == "STANDARD", F.lit("DNP"))
        .when(F.col("p_type") == "PROMO", F.lit(None))
        .otherwise(clock)
    )
    return t.part.select("p_partkey", text.alias("minutes"))


@query("parse_duration", f"""WITH d AS (SELECT p_partkey, {_DUR} AS m FROM part) SELECT p_partkey,
{r("coalesce(CASE WHEN contains(m, ':') THEN TRY_CAST(split_part(m, ':', 1) AS DOUBLE) + TRY_CAST(split_part(m, ':', 2) AS DOUBLE) / 60 ELSE TRY_CAST(m AS DOUBLE) END, 0)", 'minutes')} FROM d""")
def parse_duration(t):
    return durations(t).select("p_partkey", K.parse_duration("minutes").alias("minutes"))


@query("to_numeric_coerce", f"""WITH d AS (SELECT p_partkey, {_DUR} AS m FROM part) SELECT p_partkey, {r('TRY_CAST(m AS DOUBLE)', 'number')} FROM d""")
def to_numeric_coerce(t):
    return durations(t).select("p_partkey", K.to_number("minutes").alias("number"))


_DATE = """CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%b %d, %Y')
  WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'n/a' END"""


@query("to_date_coerce", f"""WITH d AS (SELECT o_orderkey, {_DATE} AS s FROM orders), p AS (SELECT o_orderkey,
  CAST(coalesce(try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%b %d, %Y'), try_strptime(s, '%m/%d/%Y')) AS DATE) AS day FROM d)
SELECT o_orderkey, day, {n('sum(CASE WHEN day IS NULL THEN 1 ELSE 0 END) OVER ()', 'bad_dates')} FROM p""")
def to_date_coerce(t):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format(d, "MMM dd, yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(p == "5-LOW", F.date_format(d, "MM/dd/yyyy"))
        .otherwise("n/a")
    )
    out = t.orders.select("o_orderkey", K.to_date_coerce(text).alias("day"))
    return out.withColumn("bad_dates", out.agg(F.count_if(F.col("day").isNull())).scalar())


@query("pct_to_fraction", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
{r('round(l_discount * 100) / 100', 'share')} FROM lineitem""")
def pct_to_fraction(t):
    text = F.concat(F.format_string("%.0f", F.col("l_discount") * 100), F.lit("%"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        K.pct_to_fraction(text).alias("share"),
    )


_LABEL = "upper(substr(c_mktsegment, 1, 3)) || CASE WHEN o_orderstatus = 'F' THEN ' vs. ' ELSE ' @ ' END || upper(substr(n_name, 1, 3))"


@query("regex_home_opponent", f"""WITH d AS (SELECT o_orderkey, {_LABEL} AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey, {n("regexp_matches(label, 'vs\\.')", 'is_home')}, nullif(regexp_extract(label, '(vs\\.|@)\\s+([A-Z]{{3}})', 2), '') AS opponent,
nullif(regexp_extract(label, '([A-Z]{{3}})', 1), '') AS team, split_part(label, ' ', 1) AS token FROM d""")
def regex_home_opponent(t):
    d = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.concat(
                F.upper(F.substring("c_mktsegment", 1, 3)),
                F.when(F.col("o_orderstatus") == "F", " vs. ").otherwise(" @ "),
                F.upper(F.substring("n_name", 1, 3)),
            ).alias("label"),
        )
    )
    return d.select(
        "o_orderkey",
        K.home_flag("label").alias("is_home"),
        K.opponent_of("label").alias("opponent"),
        K.team_of("label").alias("team"),
        K.first_token("label").alias("token"),
    )


@query("name_standardise", """SELECT c_custkey, coalesce(CASE trim(c_mktsegment) WHEN 'MACHINERY' THEN 'Machines' WHEN 'HOUSEHOLD' THEN 'Home' END, trim(c_mktsegment)) AS name,
split_part(c_name, '#', 1) AS first_part FROM customer""")
def name_standardise(t):
    padded = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    comma = F.regexp_replace("c_name", "#", ", ")
    return t.customer.select(
        "c_custkey",
        K.name_standardise(padded, {"MACHINERY": "Machines", "HOUSEHOLD": "Home"}).alias("name"),
        K.name_standardise(comma, before_comma=True).alias("first_part"),
    )


@query("season_label", f"SELECT o_orderkey, {SEASON_SQL.format(d='o_orderdate')} AS season FROM orders")
def season_label(t):
    return t.orders.select("o_orderkey", K.season_label("o_orderdate").alias("season"))


@query("season_id_decode", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN printf('%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100) END AS season FROM orders""")
def season_id_decode(t):
    code = F.when(F.col("o_orderstatus") == "P", "2x").otherwise(F.concat(F.lit("2"), F.year("o_orderdate").cast("string")))
    return t.orders.select("o_orderkey", K.season_id_decode(code).alias("season"))


@query("season_lookup", f"""SELECT DISTINCT {SEASON_SQL.format(d='o_orderdate')} AS season, {SEASON_SQL.format(d="(o_orderdate - INTERVAL 1 YEAR)")} AS previous FROM orders""")
def season_lookup(t):
    s = t.orders.select(K.season_label("o_orderdate").alias("season")).distinct()
    return s.withColumn("previous", K.season_lookup("season"))


@query("sum_target", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('l_quantity + l_discount + l_tax', 'total')} FROM lineitem")
def sum_target(t):
    out = K.sum_target(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "total")
    return K.sum_target(out, ["l_quantity"], "total").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "total")


# Order-level sums as a box score.
BOX_SQL = """box AS (SELECT l_orderkey, sum(l_quantity) AS pts, count(*) * 3 AS reb, sum(l_discount) * 100 AS ast, sum(l_tax) * 100 AS stl,
  sum(CASE WHEN l_returnflag = 'R' THEN 6 ELSE 0 END) AS blk, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS tov,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS fga FROM lineitem GROUP BY 1)"""


def box(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("pts"),
        (F.count(F.lit(1)) * 3).alias("reb"),
        (F.sum("l_discount") * 100).alias("ast"),
        (F.sum("l_tax") * 100).alias("stl"),
        F.sum(F.when(F.col("l_returnflag") == "R", 6).otherwise(0)).alias("blk"),
        F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("tov"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("fga"),
    ).withColumns({"ast": F.round("ast"), "stl": F.round("stl")})


_BOX = BOX_SQL.replace("sum(l_discount) * 100 AS ast", "round(sum(l_discount) * 100) AS ast").replace(
    "sum(l_tax) * 100 AS stl", "round(sum(l_tax) * 100) AS stl"
)
_REACH = " + ".join(f"CASE WHEN {c} >= 10 THEN 1 ELSE 0 END" for c in ("pts", "reb", "ast", "stl", "blk"))


@query("weighted_scores", f"""WITH {_BOX}, c AS (SELECT *, {_REACH} AS reach FROM box) SELECT l_orderkey,
{r('pts + 1.2e0 * reb + 1.5e0 * ast + 3 * stl + 3 * blk - tov', 'fantasy_score')},
{r('pts + 1.25e0 * reb + 1.5e0 * ast + 2 * stl + 2 * blk - 0.5e0 * tov + CASE WHEN reach >= 2 THEN 1.5e0 ELSE 0 END + CASE WHEN reach >= 3 THEN 3 ELSE 0 END', 'dk_score')},
{r('pts + 1.2e0 * reb + 1.5e0 * ast + 3 * stl + 3 * blk - tov', 'fd_score')} FROM c""")
def weighted_scores(t):
    return K.weighted_scores(box(t)).select("l_orderkey", "fantasy_score", "dk_score", "fd_score")


@query("threshold_count", f"""WITH {_BOX}, c AS (SELECT *, {_REACH} AS reach FROM box)
SELECT l_orderkey, {n('reach', 'reached')}, reach >= 2 AS double_double, reach >= 3 AS triple_double FROM c""")
def threshold_count(t):
    b = K.weighted_scores(box(t))
    return b.select(
        "l_orderkey", K.threshold_count(["pts", "reb", "ast", "stl", "blk"]).alias("reached"), "double_double", "triple_double"
    )


@query("ratio_features", f"""WITH {_BOX} SELECT l_orderkey, {r('(stl + 0.5e0 * blk) / nullif(fga, 0)', 'efg_pct')},
{r('pts / nullif(2 * (fga + 0.44e0 * ast), 0)', 'true_shooting_pct')}, {r('tov / nullif(reb, 0)', 'offensive_rebound_pct')},
{r('blk / nullif(reb, 0)', 'defensive_rebound_pct')}, {r('stl + blk', 'defensive_stocks')}, {r('stl / nullif(pts, 0) * 36', 'steals_per_36')},
{r('blk / nullif(pts, 0) * 36', 'blocks_per_36')} FROM box""")
def ratio_features(t):
    names = {"fgm": "stl", "fg3m": "blk", "fta": "ast", "oreb": "tov", "dreb": "blk", "minutes": "pts"}
    return K.ratio_features(box(t), names).select(
        "l_orderkey", "efg_pct", "true_shooting_pct", "offensive_rebound_pct", "defensive_rebound_pct",
        F.col("defensive_stocks").cast("double"), "steals_per_36", "blocks_per_36",
    )


@query("usage_projection", f"""WITH {_BOX} SELECT l_orderkey, {r('pts', 'usage_rate')}, {r('NULL', 'usage_rate_rank')}, {r('ast', 'points_per_shot_attempt')},
{r('NULL', 'psa_rank')} FROM box""")
def usage_projection(t):
    return K.usage_projection(box(t).withColumnsRenamed({"pts": "usage", "ast": "psa"}), "l_orderkey")


@query("playmaking_projection", f"""WITH {_BOX} SELECT l_orderkey, {r('ast', 'assist_rate')}, {r('NULL', 'assist_rate_rank')}, {r('pts', 'ast_to_usage_ratio')},
{r('tov', 'turnover_rate')}, {r('NULL', 'turnover_rate_rank')} FROM box""")
def playmaking_projection(t):
    return K.playmaking_projection(
        box(t).withColumnsRenamed({"ast": "ast%", "pts": "ast:usg", "tov": "tov%"}), "l_orderkey"
    )


@query("role_flags", f"""WITH {_BOX}, c AS (SELECT l_orderkey, stl / nullif(ast, 0) AS u, ast / nullif(pts, 0) AS a, blk, fga FROM box)
SELECT l_orderkey, {n('coalesce(u >= 0.25e0, false)', 'is_high_usage')}, {n('coalesce(u < 0.18e0, false)', 'is_low_usage')},
{n('coalesce(a >= 0.25e0, false)', 'is_primary_playmaker')}, {n('coalesce(blk / nullif(fga, 0) >= 0.5e0, false)', 'is_three_point_specialist')} FROM c""")
def role_flags(t):
    b = box(t).withColumns(
        {"u": F.col("stl") / F.nullif(F.col("ast"), F.lit(0.0)), "a": F.col("ast") / F.nullif(F.col("pts"), F.lit(0.0))}
    )
    return K.role_flags(b, "u", "a", "blk", "fga").select(
        "l_orderkey", "is_high_usage", "is_low_usage", "is_primary_playmaker", "is_three_point_specialist"
    )


@query("safe_divide", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('coalesce(l_quantity / nullif(l_discount, 0), 0)', 'ratio')}, {r('l_quantity / nullif(l_tax, 0)', 'ratio_null')} FROM lineitem")
def safe_divide(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        K.safe_divide("l_quantity", "l_discount").alias("ratio"),
        K.safe_divide("l_quantity", "l_tax", None).alias("ratio_null"),
    )


@query("z_score", f"""WITH {SEG_SQL}, g AS (SELECT segment, avg(v) AS m, stddev_samp(v) AS s FROM so GROUP BY 1)
SELECT o_orderkey, {r('(v - m) / nullif(s, 0)', 'z')} FROM so JOIN g USING (segment)""")
def z_score(t):
    so = segment_orders(t)
    g = so.groupBy("segment").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return so.join(g, "segment").select("o_orderkey", K.z_score("v", "m", "s").alias("z"))


@query("one_hot", f"""WITH {SEG_SQL} SELECT o_orderkey, {', '.join(n(f"segment = '{s}'", f"is_{s.lower()}") for s in ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))} FROM so""")
def one_hot(t):
    out = C.one_hot(segment_orders(t), "segment", ("BUILDING", "MACHINERY", "HOUSEHOLD"))
    return out.select("o_orderkey", "is_building", "is_machinery", "is_household")


_ELITE_BARS = {"BUILDING": (200, 250, 300), "MACHINERY": (220, 240, 260), "Wing": (240, 250, 260)}


@query("elite_flag", f"""WITH {SEG_SQL}, f AS (SELECT *, avg(v) OVER ({CUST_W} {rows(5)}) AS p, lag(v) OVER ({CUST_W}) AS a, lag(v, 2) OVER ({CUST_W}) AS rb FROM so)
SELECT o_orderkey, {n('''coalesce(CASE segment WHEN 'BUILDING' THEN p >= 200 AND (a >= 250 OR rb >= 300) WHEN 'MACHINERY' THEN p >= 220 AND (a >= 240 OR rb >= 260)
ELSE p >= 240 AND (a >= 250 OR rb >= 260) END, false)''', 'is_elite')} FROM f""")
def elite_flag(t):
    from chronoplane.operators.timeline import on_timeline

    k = order_keys(t)
    f = on_timeline(
        segment_orders(t), k,
        lambda tl: tl.look_back(5, {
            "p": lambda w: F.avg("v").over(H.rows_before(w, 5)),
            "a": lambda w: F.lag("v").over(w),
            "rb": lambda w: F.lag("v", 2).over(w),
        }), reach=5,
    )
    return C.elite_flag(f, "segment", "p", "a", "rb", _ELITE_BARS).select("o_orderkey", "is_elite")


@query("calendar_features", f"""SELECT o_orderkey, {n('month(o_orderdate)', 'game_month')}, {n('month(o_orderdate) IN (10, 11)', 'is_early_season')},
{n('month(o_orderdate) IN (12, 1, 2)', 'is_mid_season')}, {n('month(o_orderdate) IN (3, 4)', 'is_late_season')}, {n('month(o_orderdate) IN (5, 6)', 'is_playoff_month')},
{n('isodow(o_orderdate) - 1', 'day_of_week')}, {n('isodow(o_orderdate) IN (5, 6, 7)', 'is_weekend')} FROM orders""")
def calendar_features(t):
    return K.calendar_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("home_flag", f"""SELECT event_id, user_id, ts, {n("event_type = 'click'", 'is_home')} FROM events""")
def home_flag(t):
    e = events(t).withColumn("is_home", (F.col("event_type") == "click").cast("int"))
    return K.base_projection(e, event_keys(t).grain, "is_home")


@query("clip", f"SELECT event_id, {r('greatest(least(value, 100), 5)', 'clipped')}, {r('CASE WHEN value > 50 THEN greatest(value, 60) END', 'low_only')} FROM events")
def clip(t):
    some = F.when(F.col("value") > 50, F.col("value"))
    return t.events.select("event_id", K.clip("value", 5, 100).alias("clipped"), K.clip(some, low=60).alias("low_only"))


@query("player_filter", f"""WITH c AS (SELECT o_custkey, count(*) AS career, sum(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END) AS recent FROM orders GROUP BY 1)
SELECT o_custkey, {n('career', 'career_games')}, {n('recent', 'recent_games')} FROM c WHERE career >= 5 AND recent >= 3""")
def player_filter(t):
    per = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("career_games"),
        F.count_if(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).alias("recent_games"),
    )
    return K.player_filter(per)


@query("select_features", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('l_discount', 'l_discount')}, {r('l_tax', 'l_tax')}, {r('l_quantity', 'l_quantity')} FROM lineitem")
def select_features(t):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    names = K.select_features(t.lineitem, "l_quantity", (*keys, "l_extendedprice"))
    return K.feature_matrix(t.lineitem, "l_quantity", names, keys, fill=0.0)


@query("upcoming_filter", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' UNION ALL SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00'")
def upcoming_filter(t):
    e = t.events.select("event_id", "ts")
    on_day = K.upcoming_filter(e, "ts", "2024-01-15")
    after = K.upcoming_filter(e, "ts", now=F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))
    return on_day.unionByName(after)


_ODDS = "CASE WHEN l_returnflag = 'A' THEN -l_quantity * 10 - 100 ELSE l_quantity * 5 + 100 END"


def _odds(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", -q * 10 - 100).otherwise(q * 5 + 100).alias("odds"),
        (F.col("l_discount") * 5 + 0.3).alias("p"),
    )


@query("american_odds", f"""WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_ODDS} AS odds FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('CASE WHEN odds < 0 THEN -odds / (-odds + 100) ELSE 100 / (odds + 100) END', 'breakeven')},
{r('CASE WHEN odds < 0 THEN 100 / -odds ELSE odds / 100 END', 'payoff')} FROM d""")
def american_odds(t):
    d = _odds(t)
    return d.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        O.american_to_probability("odds").alias("breakeven"), O.payoff("odds").alias("payoff"),
    )


_D_SQL = f"""d0 AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_ODDS} AS odds, l_discount * 5 + 0.3e0 AS p FROM lineitem),
d AS (SELECT *, CASE WHEN odds < 0 THEN 100 / -odds ELSE odds / 100 END AS b, CASE WHEN odds < 0 THEN -odds / (-odds + 100) ELSE 100 / (odds + 100) END AS be FROM d0)"""


@query("edge", f"WITH {_D_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('p - be', 'edge')} FROM d")
def edge(t):
    return _odds(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", O.edge("p", "odds").alias("edge"))


@query("kelly_size", f"""WITH {_D_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
{r('CASE WHEN p - 1 / (1 + b) >= 0.03e0 THEN least(greatest((p * b - (1 - p)) / b * 0.25e0, 0), 0.25e0) ELSE 0 END', 'kelly')},
{r('greatest((p * b - (1 - p)) / b * 0.25e0, 0)', 'kelly_uncapped')} FROM d""")
def kelly_size(t):
    return _odds(t).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        O.kelly_size("p", "odds").alias("kelly"), O.kelly_uncapped("p", "odds").alias("kelly_uncapped"),
    )


@query("bet_strength", """WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount * 2 AS e, l_quantity / 50 AS c FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN e >= 0.15e0 AND c >= 0.85e0 THEN 'STRONG' WHEN e >= 0.10e0 AND c >= 0.75e0 THEN 'GOOD' ELSE 'OK' END AS strength FROM d""")
def bet_strength(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        O.bet_strength(F.col("l_discount") * 2, F.col("l_quantity") / 50).alias("strength"),
    )


