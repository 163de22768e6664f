"""Queries of the split, imputation and data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import history as H
from chronoplane.operators import imputation as I
from chronoplane.operators import quality as Q
from chronoplane.operators import splits as S
from chronoplane.plans.bindings import CUST_W, O_SQL, SEG_SQL, order_keys, orders, rows, segment_orders
from chronoplane.plans.registry import n, query, r

_SPLIT = "CASE WHEN o_orderdate < TIMESTAMP '1998-10-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-10-01' THEN 'val' ELSE 'test' END"


@query("chrono_split", f"SELECT o_orderkey, {_SPLIT} AS split FROM orders")
def chrono_split(t):
    return S.chrono_split(t.orders, "o_orderdate", "1998-10-01", "1999-10-01").select("o_orderkey", "split")


@query("split_bounds", f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM orders)
SELECT split, {n('count(*)', 'rows')}, min(o_orderdate) AS first, max(o_orderdate) AS last, false AS overlaps FROM s GROUP BY 1""")
def split_bounds(t):
    return S.split_bounds(S.chrono_split(t.orders, "o_orderdate", "1998-10-01", "1999-10-01"), "o_orderdate")


@query("global_rank", f"SELECT o_orderkey, {n('row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1', 'rank')}, {n('count(*) OVER ()', 'total')} FROM orders")
def global_rank(t):
    return S.global_rank(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "rank", "total")


@query("contiguous_folds", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rk, count(*) OVER () AS c FROM orders),
f AS (SELECT *, least(rk // (c // 19), 18) AS fold FROM k),
g AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rk) - 1 AS i, count(*) OVER (PARTITION BY fold) AS len FROM f)
SELECT o_orderkey, {n('fold', 'fold')}, CASE WHEN i >= len - CAST(floor(len * 0.2e0) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM g""")
def contiguous_folds(t):
    return S.contiguous_folds(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "fold", "split")


@query("expanding_folds", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rk, count(*) OVER () AS c FROM orders),
f AS (SELECT i, c, c // 20 AS size, c - (19 - i) * (c // 20) AS start FROM (SELECT DISTINCT c FROM k), range(19) t(i))
SELECT o_orderkey, {n('(SELECT min(i) FROM f WHERE rk < start)', 'train_from')}, {n('(SELECT min(i) FROM f WHERE rk >= start AND rk < start + CAST(floor(size * 0.2e0) AS BIGINT))', 'val_fold')} FROM k""")
def expanding_folds(t):
    return S.expanding_folds(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "train_from", "val_fold")


_GAP = 2
_SEASONS = "ss AS (SELECT season, row_number() OVER (ORDER BY season) AS si FROM (SELECT DISTINCT season FROM o))"
_GAP_SQL = f"""{_SEASONS}, k AS (SELECT o.*, si, row_number() OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) AS pos FROM o JOIN ss USING (season)),
g AS (SELECT o_custkey, season, si, min(CASE WHEN pos = {_GAP + 1} THEN o_orderdate END) AS from_date FROM k GROUP BY 1, 2, 3),
h AS (SELECT *, coalesce(lag(si) OVER (PARTITION BY o_custkey ORDER BY si) >= si - 3, false) AS known FROM g),
gap AS (SELECT k.*, coalesce(known AND o_orderdate < from_date, false) AS in_gap FROM k JOIN h ON k.o_custkey = h.o_custkey AND k.season = h.season)"""


@query("entity_gap", f"WITH {O_SQL}, {_GAP_SQL} SELECT o_orderkey, o_custkey, season, in_gap FROM gap")
def entity_gap(t):
    return S.entity_gap(orders(t), order_keys(t), _GAP, 3).select("o_orderkey", "o_custkey", "season", "in_gap")


@query("season_cv", f"""WITH {O_SQL}, {_GAP_SQL}, c AS (SELECT si, count(*) AS c, count(*) FILTER (NOT in_gap) AS kept FROM gap GROUP BY 1),
f AS (SELECT si AS test, row_number() OVER (ORDER BY si) - 1 AS fold FROM c WHERE si > 3 AND c >= 100 AND kept >= 100),
tr AS (SELECT fold, o_orderkey, row_number() OVER (PARTITION BY fold ORDER BY o_orderdate, o_orderkey) AS rk, count(*) OVER (PARTITION BY fold) AS c FROM gap JOIN f ON si BETWEEN test - 3 AND test - 1)
SELECT {n('fold', 'fold')}, o_orderkey, CASE WHEN rk <= floor(c * (1 - 0.2e0)) THEN 'train' ELSE 'val' END AS split FROM tr
UNION ALL SELECT CAST(fold AS BIGINT), o_orderkey, 'test' FROM gap JOIN f ON si = test WHERE NOT in_gap""")
def season_cv(t):
    return S.season_cv(orders(t), order_keys(t), 3, _GAP, 100).select("fold", "o_orderkey", "split")


# --- imputation ------------------------------------------------------------------------------------------

# Two value columns with gaps: x is missing for status P, w for priority 5.
_X_SQL = SEG_SQL + """, x AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN v END AS x, CASE WHEN o_orderpriority <> '5-LOW' THEN v * 2 END AS w,
  o_orderdate < TIMESTAMP '1999-01-01' AS is_train FROM so)"""
_BASE_SQL = _X_SQL + """, b AS (SELECT segment, avg(x) AS xm, stddev_samp(x) AS xs, quantile_cont(x, 0.5) AS xq, count(x) AS xc,
  avg(w) AS wm, stddev_samp(w) AS ws, quantile_cont(w, 0.5) AS wq, count(w) AS wc FROM x WHERE is_train GROUP BY 1)"""


def gappy(t):
    so = segment_orders(t)
    return so.withColumns(
        {
            "x": F.when(F.col("o_orderstatus") != "P", F.col("v")),
            "w": F.when(F.col("o_orderpriority") != "5-LOW", F.col("v") * 2),
        }
    )


def train_rows(df):
    return df.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))


@query("group_baselines", f"""WITH {_BASE_SQL} SELECT segment, {r('xm', 'x_mean')}, {r('xs', 'x_std')}, {r('xq', 'x_median')}, {n('xc', 'x_count')},
{r('wm', 'w_mean')}, {r('ws', 'w_std')}, {r('wq', 'w_median')}, {n('wc', 'w_count')} FROM b""")
def group_baselines(t):
    return I.group_baselines(train_rows(gappy(t)), "segment", ["x", "w"], t.hot_rows)


@query("impute_fit_apply", f"""WITH {_X_SQL}, f AS (SELECT quantile_cont(x, 0.5) AS xq, quantile_cont(w, 0.5) AS wq FROM x WHERE is_train)
SELECT o_orderkey, {r('coalesce(x, (SELECT xq FROM f))', 'x')}, {r('coalesce(w, (SELECT wq FROM f))', 'w')} FROM x""")
def impute_fit_apply(t):
    g = gappy(t)
    return I.impute_fit_apply(train_rows(g), g, ["x", "w"], "median", t.hot_rows).select("o_orderkey", "x", "w")


@query("impute_fit_apply_mean", f"""WITH {_X_SQL}, f AS (SELECT avg(x) AS xq, avg(w) AS wq FROM x WHERE is_train)
SELECT o_orderkey, {r('coalesce(x, (SELECT xq FROM f))', 'x')}, {r('coalesce(w, 0)', 'w0')} FROM x""")
def impute_fit_apply_mean(t):
    g = gappy(t).withColumn("w0", F.col("w"))
    tr = train_rows(g)
    return I.impute_fit_apply(tr, I.impute_fit_apply(tr, g, "x", "mean"), "w0", "zero").select("o_orderkey", "x", "w0")


@query("impute_by_group", f"WITH {_BASE_SQL} SELECT o_orderkey, {r('coalesce(x, xm)', 'x')}, {r('coalesce(w, wm)', 'w')} FROM x LEFT JOIN b USING (segment)")
def impute_by_group(t):
    g = gappy(t)
    b = I.group_baselines(train_rows(g), "segment", ["x", "w"], t.hot_rows)
    return I.impute_by_group(g, b, "segment", ["x", "w"]).select("o_orderkey", "x", "w")


@query("impute_by_group_median", f"WITH {_BASE_SQL} SELECT o_orderkey, {r('coalesce(x, xq)', 'x')}, {r('coalesce(w, wq)', 'w')} FROM x LEFT JOIN b USING (segment)")
def impute_by_group_median(t):
    g = gappy(t)
    b = I.group_baselines(train_rows(g), "segment", ["x", "w"], t.hot_rows)
    return I.impute_by_group(g, b, "segment", ["x", "w"], "position_median").select("o_orderkey", "x", "w")


@query("group_relative", f"""WITH {_BASE_SQL} SELECT o_orderkey, {r('x - xm', 'x_vs_group')}, {r('(x - xm) / nullif(xs, 0)', 'x_group_z')},
{r('w - wm', 'w_vs_group')}, {r('(w - wm) / nullif(ws, 0)', 'w_group_z')} FROM x LEFT JOIN b USING (segment)""")
def group_relative(t):
    g = gappy(t)
    b = I.group_baselines(train_rows(g), "segment", ["x", "w"], t.hot_rows)
    return I.group_relative(g, b, "segment", ["x", "w"]).select(
        "o_orderkey", "x_vs_group", "x_group_z", "w_vs_group", "w_group_z"
    )


@query("impute_pipeline", f"""WITH {_BASE_SQL}, h AS (SELECT *, count(x) OVER ({CUST_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM x),
j AS (SELECT h.*, xm, xs, wm, ws, coalesce(x, xm) AS xi, coalesce(w, wm) AS wi FROM h LEFT JOIN b USING (segment))
SELECT o_orderkey, {r('xi', 'x')}, {r('wi', 'w')}, {n('x IS NOT NULL', 'has_value')}, {n('c = 0', 'is_first')}, {n('c', 'history_rows')},
{r('CASE WHEN x IS NULL THEN 0 ELSE least(c / 5e0, 1) END', 'data_quality')}, {r('xi - xm', 'x_vs_group')}, {r('(wi - wm) / nullif(ws, 0)', 'w_group_z')}, {r('NULL', 'prev_season_x')} FROM j""")
def impute_pipeline(t):
    g = gappy(t)
    b = I.group_baselines(train_rows(g), "segment", ["x", "w"], t.hot_rows)
    return I.impute_pipeline(g, b, order_keys(t), "segment", ["x", "w"], "x").select(
        "o_orderkey", "x", "w", "has_value", "is_first", "history_rows", "data_quality", "x_vs_group", "w_group_z", "prev_season_x"
    )


# --- quality ---------------------------------------------------------------------------------------------

@query("check_grain", f"SELECT l_orderkey, l_linenumber, {n('count(*)', 'n')} FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_grain(t):
    return Q.check_grain(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("null_profile", f"""WITH {_X_SQL}, c AS (SELECT count(*) AS c, count(x) AS x, count(w) AS w, count(v) AS v FROM x),
l AS (SELECT 'x' AS "column", c - x AS k, c FROM c UNION ALL SELECT 'w', c - w, c FROM c UNION ALL SELECT 'v', c - v, c FROM c)
SELECT "column", {n('k', 'n_null')}, {r('k * 100e0 / c', 'pct_null')}, CASE WHEN k * 100e0 / c > 50 THEN 'ERROR' WHEN k * 100e0 / c > 10 THEN 'WARN' ELSE 'INFO' END AS level FROM l""")
def null_profile(t):
    return Q.null_profile(gappy(t), ["x", "w", "v"])


@query("check_range", f"""SELECT 'l_discount' AS "column", {r('min(l_discount)', 'min_value')}, {r('max(l_discount)', 'max_value')}, min(l_discount) >= 0 AND max(l_discount) <= 1 AS in_range FROM lineitem
UNION ALL SELECT 'l_quantity', {r('min(l_quantity)', 'a')}, {r('max(l_quantity)', 'b')}, min(l_quantity) >= 1 AND max(l_quantity) <= 40 FROM lineitem""")
def check_range(t):
    return Q.check_range(t.lineitem, {"l_discount": (0, 1), "l_quantity": (1, 40)})


@query("check_first_rows", f"""WITH {O_SQL}, f AS (SELECT *, row_number() OVER ({CUST_W}) AS k, avg(v) OVER ({CUST_W} {rows(5)}) AS m FROM o)
SELECT 'v_mean_5' AS feature, {n('count(*)', 'n_entities')}, {n('count(*) FILTER (coalesce(m, 0) <> 0)', 'n_leaking')} FROM f WHERE k = 1
UNION ALL SELECT 'v', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (coalesce(v, 0) <> 0) AS BIGINT) FROM f WHERE k = 1""")
def check_first_rows(t):
    k = order_keys(t)
    out = Q.check_first_rows(H.lag_roll_mean(orders(t), k, "v", (5,)), k, ["v_mean_5", "v"])
    return out.select("feature", "n_entities", "n_leaking")


@query("check_distribution", f"""WITH d AS (SELECT l_quantity / nullif(l_tax, 0) AS a, l_extendedprice * 100 AS b, CASE WHEN l_tax = 0 THEN CAST('inf' AS DOUBLE) ELSE l_tax END AS c, 1e0 AS d FROM lineitem),
l AS (SELECT 'a' AS "column", a AS x FROM d UNION ALL SELECT 'b', b FROM d UNION ALL SELECT 'c', c FROM d UNION ALL SELECT 'd', d FROM d)
SELECT "column", {n('count(*) FILTER (isinf(x))', 'n_infinite')}, {n('count(*) FILTER (abs(x) > 1e6 AND NOT isinf(x))', 'n_huge')}, coalesce(min(x) = max(x), true) AS is_constant FROM l GROUP BY 1""")
def check_distribution(t):
    tax = F.col("l_tax")
    d = t.lineitem.select(
        (F.col("l_quantity") / F.nullif(tax, F.lit(0.0))).alias("a"),
        (F.col("l_extendedprice") * 100).alias("b"),
        F.when(tax == 0, F.lit(float("inf"))).otherwise(tax).alias("c"),
        F.lit(1.0).alias("d"),
    )
    return Q.check_distribution(d, ["a", "b", "c", "d"])


@query("check_feature_rules", f"""WITH g AS (SELECT *, coalesce(date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)), 3) AS d FROM events)
SELECT 'flag_is_binary' AS rule, bool_and(CAST(d = 1 AS INT) IN (0, 1)) AS holds FROM g UNION ALL SELECT 'mean_gap', avg(d) > 1 AND avg(d) < 12 FROM g UNION ALL SELECT 'value_range', min(value) >= 0 AND max(value) <= 100 FROM g""")
def check_feature_rules(t):
    from chronoplane.plans.bindings import event_keys, events

    g = H.gap_flags(events(t), event_keys(t))
    return Q.check_feature_rules(
        g,
        {
            "flag_is_binary": Q.is_binary("is_back_to_back"),
            "mean_gap": Q.mean_between("days_since_last", 1, 12),
            "value_range": Q.is_between("value", 0, 100),
        },
    )


@query("check_values", f"""SELECT 'negative:l_quantity' AS "check", {n('count(*) FILTER (l_quantity < 0)', 'n')} FROM lineitem
UNION ALL SELECT 'above:l_extendedprice', CAST(count(*) FILTER (l_extendedprice > 90000) AS BIGINT) FROM lineitem
UNION ALL SELECT 'not_fraction:l_discount', CAST(count(*) FILTER (l_discount < 0 OR l_discount > 1) AS BIGINT) FROM lineitem
UNION ALL SELECT 'sum_mismatch:l_quantity', CAST(count(*) FILTER (abs(l_discount + l_tax - l_quantity) > 1e-9) AS BIGINT) FROM lineitem
UNION ALL SELECT 'zero:l_tax', CAST(count(*) FILTER (l_tax = 0) AS BIGINT) FROM lineitem
UNION ALL SELECT 'duplicate:l_orderkey,l_linenumber', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) FROM lineitem""")
def check_values(t):
    return Q.check_values(
        t.lineitem, ["l_quantity"], {"l_extendedprice": 90000}, ["l_discount"], ["l_discount", "l_tax"], "l_quantity",
        ["l_orderkey", "l_linenumber"], "l_tax",
    )


@query("quality_report", f"""WITH {_X_SQL}, c AS (SELECT count(*) AS c, count(x) AS x, count(w) AS w, avg(v) AS m, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi, min(w) AS wl, max(w) AS wh FROM x),
l AS (SELECT 'missing_pct' AS ck, 'v' AS col, 0e0 AS val, 'INFO' AS level UNION ALL
  SELECT 'missing_pct', 'x', (c - x) * 100e0 / c, CASE WHEN (c - x) * 100e0 / c > 50 THEN 'ERROR' WHEN (c - x) * 100e0 / c > 10 THEN 'WARN' ELSE 'INFO' END FROM c UNION ALL
  SELECT 'missing_pct', 'w', (c - w) * 100e0 / c, CASE WHEN (c - w) * 100e0 / c > 50 THEN 'ERROR' WHEN (c - w) * 100e0 / c > 10 THEN 'WARN' ELSE 'INFO' END FROM c UNION ALL
  SELECT 'duplicate_keys', 'o_custkey,o_orderdate', count(*), CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'INFO' END FROM (SELECT 1 FROM x GROUP BY o_custkey, o_orderdate HAVING count(*) > 1) UNION ALL
  SELECT 'range', 'v', CASE WHEN lo >= 0 AND hi <= 600 THEN 1 ELSE 0 END, CASE WHEN lo >= 0 AND hi <= 600 THEN 'INFO' ELSE 'WARN' END FROM c UNION ALL
  SELECT 'range', 'w', CASE WHEN wl >= 0 AND wh <= 600 THEN 1 ELSE 0 END, CASE WHEN wl >= 0 AND wh <= 600 THEN 'INFO' ELSE 'WARN' END FROM c UNION ALL
  SELECT 'target_rows', 'v', c, 'INFO' FROM c UNION ALL SELECT 'target_mean', 'v', m, 'INFO' FROM c UNION ALL SELECT 'target_std', 'v', sd, 'INFO' FROM c UNION ALL
  SELECT 'target_min', 'v', lo, 'INFO' FROM c UNION ALL SELECT 'target_max', 'v', hi, 'INFO' FROM c)
SELECT ck AS "check", col AS "column", {r('val', 'value')}, level FROM l""")
def quality_report(t):
    g = gappy(t).select("o_custkey", "o_orderdate", "v", "x", "w")
    return Q.quality_report(g, ["o_custkey", "o_orderdate"], "v", {"v": (0, 600), "w": (0, 600)})
