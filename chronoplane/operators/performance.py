"""How the decisions did: totals, tiers, per entity and day, stability, significance, equity.

Per-day frames have one row per calendar day; that bound is what lets a window over all days run in one
partition. Everything finer goes through `on_timeline`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.functions import odds as O
from chronoplane.functions.special import binomial_tail, t_quantile, t_two_sided
from chronoplane.keys import Keys
from chronoplane.operators.accuracy import equal_width_bin
from chronoplane.operators.decisions import BREAK_EVEN_RATE, LOSS_PROFIT, WIN_PROFIT
from chronoplane.operators.quantiles import exact_quantiles
from chronoplane.operators.timeline import Running, on_timeline

# Edge tiers; normal quantiles of the 90, 95 and 99 percent intervals; days of a rolling rate;
# rows below which an entity is a small sample.
EDGE_TIERS = {"small": 1.0, "medium": 2.0, "large": 3.0}
Z_LEVELS = {90: 1.6448536269514722, 95: 1.959963984540054, 99: 2.5758293035489004}
ROLLING_DAYS = 30
SMALL_SAMPLE = 15


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def bet_totals(df: DataFrame, keys: Keys, correct: str = "bet_correct", profit: str = "profit",
               break_even: float = BREAK_EVEN_RATE) -> DataFrame:
    """Counts, win rate, profit, return, and last / highest / lowest running profit, over rows with a line."""
    bets = df.filter("has_line")
    line = Keys((), keys.time, (*keys.entity, *keys.event), hot_rows=keys.hot_rows)
    run = on_timeline(
        bets, line, lambda t: t.running({"__cum": Running("sum", F.col(profit), prior=False)})
    )
    wins, n = F.count_if(F.col(correct)), F.count(F.lit(1))
    one = run.agg(
        n.alias("total_bets"),
        wins.alias("wins"),
        (n - wins).alias("losses"),
        F.sum(profit).alias("total_profit"),
        F.max("__cum").alias("max_cumulative_profit"),
        F.min("__cum").alias("min_cumulative_profit"),
    )
    rate = _ratio(F.col("wins"), F.col("total_bets"))
    return one.withColumns(
        {
            "win_rate": rate,
            "win_rate_vs_breakeven": (rate - break_even) * 100,
            "is_profitable": rate > break_even,
            "roi": _ratio(F.col("total_profit"), F.col("total_bets")) * 100,
            "final_cumulative_profit": F.col("total_profit"),
        }
    )


def edge_tiers(df: DataFrame, tiers=EDGE_TIERS) -> DataFrame:
    """Nested edge tiers in one pass: bets, win rate, return and mean profit per tier."""
    one = df.filter("has_line").agg(
        F.struct(
            *[
                F.struct(
                    F.count_if(F.col("edge_size") >= e).alias("n"),
                    F.avg(F.when(F.col("edge_size") >= e, F.col("bet_correct").cast("double"))).alias("w"),
                    F.avg(F.when(F.col("edge_size") >= e, F.col("profit"))).alias("p"),
                ).alias(name)
                for name, e in tiers.items()
            ]
        ).alias("t")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("tier"),
                F.lit(float(e)).alias("threshold"),
                F.col(f"t.{name}.n").alias("edge_count"),
                F.col(f"t.{name}.w").alias("edge_win_rate"),
                (F.col(f"t.{name}.p") * 100).alias("edge_roi"),
                F.col(f"t.{name}.p").alias("edge_avg_profit"),
            )
            for name, e in tiers.items()
        ]
    )
    return one.select(F.inline(rows))


def by_player(df: DataFrame, entity: str, min_games: int = 10) -> DataFrame:
    """Per entity: wins, bets, rate, profit, mean edge and return, for entities with enough bets."""
    n, wins = F.count(F.lit(1)), F.count_if("bet_correct")
    per = df.filter("has_line").groupBy(entity).agg(
        wins.alias("wins"),
        n.alias("num_games"),
        (wins / n).alias("win_rate"),
        F.sum("profit").alias("total_profit"),
        F.avg("profit").alias("avg_profit"),
        F.avg("edge_size").alias("avg_edge"),
        (F.sum("profit") / n * 100).alias("roi"),
    )
    return per.filter(F.col("num_games") >= min_games)


def daily_totals(df: DataFrame, time: str) -> DataFrame:
    n, wins = F.count(F.lit(1)), F.count_if("bet_correct")
    return df.filter("has_line").groupBy(F.to_date(time).alias("day")).agg(
        wins.alias("wins"), n.alias("num_bets"), F.sum("profit").alias("daily_profit")
    )




def _by_day():
    return Window.partitionBy(F.lit(0)).orderBy("day")


def by_day(df: DataFrame, time: str) -> DataFrame:
    """Per day: wins, bets, rate, profit, return and running profit."""
    days = daily_totals(df, time)
    run = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns(
        {
            "win_rate": F.col("wins") / F.col("num_bets"),
            "avg_profit": F.col("daily_profit") / F.col("num_bets"),
            "roi": F.col("daily_profit") / F.col("num_bets") * 100,
            "cumulative_profit": F.sum("daily_profit").over(run),
        }
    )


def cumulative_sum(days: DataFrame) -> DataFrame:
    """Running bets, wins, profit and win rate over the days."""
    run = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns(
        {
            "cumulative_bets": F.sum("num_bets").over(run),
            "cumulative_wins": F.sum("wins").over(run),
            "cumulative_profit": F.sum("daily_profit").over(run),
        }
    ).withColumn("cumulative_win_rate", F.col("cumulative_wins") / F.col("cumulative_bets"))


def drawdown(days: DataFrame) -> DataFrame:
    """Worst fall below the running maximum of the profit, in units and percent, and share of days below it."""
    run = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    cum = days.withColumn("__cum", F.sum("daily_profit").over(run))
    peak = cum.withColumn("__peak", F.max("__cum").over(run)).withColumn("__dd", F.col("__cum") - F.col("__peak"))
    worst = F.min(F.struct(F.col("__dd"), F.col("day"), F.col("__peak")))
    one = peak.agg(
        worst.alias("__w"),
        F.avg((F.col("__dd") < 0).cast("double")).alias("time_in_drawdown"),
        F.sum("daily_profit").alias("total_profit"),
    )
    dd, at_peak = F.col("__w.__dd"), F.col("__w.__peak")
    return one.select(
        dd.alias("max_drawdown"),
        F.when(at_peak > 0, dd / at_peak * 100).otherwise(F.lit(0.0)).alias("max_drawdown_pct"),
        "time_in_drawdown",
        "total_profit",
        F.abs(_ratio(F.col("total_profit"), dd)).alias("profit_to_drawdown"),
    )


def rolling_rate(days: DataFrame, rows: int = ROLLING_DAYS) -> DataFrame:
    """Win rate over the last `rows` days, where that many are there."""
    w = _by_day().rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(w) == rows
    return days.withColumn(
        "rolling_win_rate", F.when(full, F.sum("wins").over(w) / F.sum("num_bets").over(w))
    )


def rolling_rate_summary(days: DataFrame, rows: int = ROLLING_DAYS, break_even: float = BREAK_EVEN_RATE) -> DataFrame:
    """Distribution of the rolling rate and the share of windows above break-even."""
    rated = rolling_rate(days, rows)
    q = exact_quantiles(rated, "rolling_win_rate", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    r = F.col("rolling_win_rate")
    one = rated.agg(
        F.count(r).alias("windows"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
        F.avg((r > break_even).cast("double")).alias("share_above"),
    )
    quart = q.select(F.struct("q25", "median", "q75").alias("q")).scalar()
    return one.withColumns({c: quart.getField(c) for c in ("q25", "median", "q75")})


def period_thirds(days: DataFrame) -> DataFrame:
    """Early, middle and late third of the days: bets, win rate, return, and the homogeneity test over them."""
    w = _by_day()
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    size = F.floor(n / 3)
    at = F.row_number().over(w) - 1
    third = F.when(at < size, "early").when(at < 2 * size, "middle").otherwise("late")
    per = days.withColumn("period", third).groupBy("period").agg(
        F.sum("num_bets").alias("bets"), F.sum("wins").alias("wins"), F.sum("daily_profit").alias("profit")
    )
    whole = Window.partitionBy(F.lit(0))
    share = _ratio(F.sum("wins").over(whole), F.sum("bets").over(whole))
    gap = F.col("wins") - F.col("bets") * share
    chi2 = F.sum(_ratio(gap * gap, F.col("bets") * share * (1 - share))).over(whole)
    return per.select(
        "period",
        "bets",
        "wins",
        F.coalesce(_ratio(F.col("wins"), F.col("bets")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(_ratio(F.col("profit"), F.col("bets")), F.lit(0.0)).alias("roi"),
        chi2.alias("chi2"),
        # Three periods, two outcomes: two degrees of freedom, whose tail is exp(-x / 2).
        F.exp(-chi2 / 2).alias("p_value"),
    )


def wilson(wins: Column, n: Column, z: float) -> tuple[Column, Column]:
    n = F.nullif(n, F.lit(0))
    p = wins / n
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return center - margin, center + margin


def significance(df: DataFrame, by=(), break_even: float = BREAK_EVEN_RATE, t_test: bool = True) -> DataFrame:
    """Win rate against break-even: exact binomial tail, z, Wilson intervals; mean profit: t test and interval.

    Only counts, sums and a deviation leave the data; the distribution functions see one row per group.
    """
    by = [by] if isinstance(by, str) else list(by)
    base = df.filter("has_line").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("bet_correct").alias("wins"),
        F.avg("profit").alias("mean_profit"),
        F.stddev_samp("profit").alias("std_profit"),
    )
    n, wins = F.nullif(F.col("n"), F.lit(0)), F.col("wins")
    rate = wins / n
    cols: dict[str, Column] = {
        "win_rate": rate,
        "z_score": (rate - break_even) / F.sqrt(break_even * (1 - break_even) / n),
        "p_binomial": binomial_tail(wins.cast("double"), n.cast("double"), F.lit(break_even)),
    }
    for level, z in Z_LEVELS.items():
        cols[f"ci{level}_low"], cols[f"ci{level}_high"] = wilson(wins, n, z)
    out = base.withColumns(cols)
    if not t_test:
        return out
    se = F.col("std_profit") / F.sqrt(n)
    out = out.withColumn("t_stat", F.col("mean_profit") / F.nullif(se, F.lit(0.0)))
    dof = (n - 1).cast("double")
    half = t_quantile(F.lit(0.975), dof) * se
    return out.withColumns(
        {
            "p_t": t_two_sided(F.col("t_stat"), dof),
            "profit_ci_low": F.col("mean_profit") - half,
            "profit_ci_high": F.col("mean_profit") + half,
        }
    )


def profit_shape(df: DataFrame) -> DataFrame:
    """Mean, deviation, population skewness and excess kurtosis, extremes and return per deviation of the profit."""
    p = F.col("profit")
    return df.filter("has_line").agg(
        F.avg(p).alias("mean"),
        F.stddev_samp(p).alias("std"),
        F.skewness(p).alias("skewness"),
        F.kurtosis(p).alias("kurtosis"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        (F.avg(p) / F.nullif(F.stddev_samp(p), F.lit(0.0))).alias("sharpe"),
    )


def kelly_summary(df: DataFrame, win: float = WIN_PROFIT) -> DataFrame:
    """Growth-optimal stake and expected log growth from the overall win rate."""
    one = df.filter("has_line").agg(F.avg(F.col("bet_correct").cast("double")).alias("p"))
    p, b = F.col("p"), F.lit(win)
    f = (b * p - (1 - p)) / b
    # Log growth has no value at stakes of 1 or more, or of -1/b or less.
    valid = (f < 1) & (f > -1 / b)
    growth = F.when(valid, p * F.log1p(b * f) + (1 - p) * F.log1p(-f))
    return one.select(p.alias("win_rate"), f.alias("kelly_fraction"), growth.alias("growth_rate"))


def edge_profit_corr(df: DataFrame) -> DataFrame:
    return df.filter("has_line").agg(F.corr("edge_size", "profit").alias("edge_profit_corr"))


def player_rate_distribution(per_player: DataFrame, break_even: float = BREAK_EVEN_RATE, small: int = SMALL_SAMPLE,
                             hot_rows: int | None = 1_000_000) -> DataFrame:
    """Distribution of the entities' win rates and whether small samples carry it."""
    r, n, w = F.col("win_rate"), F.col("num_games"), F.col("wins")
    one = per_player.agg(
        F.count(F.lit(1)).alias("players"),
        F.avg(r).alias("mean_rate"),
        F.stddev_pop(r).alias("std_rate"),
        F.min(r).alias("min_rate"),
        F.max(r).alias("max_rate"),
        F.count_if(r == 1.0).alias("perfect"),
        F.count_if(r > 0.9).alias("above_90"),
        F.count_if(r > break_even).alias("above_break_even"),
        F.count_if((r == 1.0) & (n < small)).alias("perfect_small"),
        (F.sum(F.when((r == 1.0) & (n < small), n).otherwise(0)) / F.sum(n)).alias("perfect_small_share"),
        (F.sum(w) / F.sum(n)).alias("weighted_rate"),
        F.avg(F.when(n < small, r)).alias("small_sample_rate"),
        F.avg(F.when(n >= small, r)).alias("large_sample_rate"),
        F.avg(n).alias("mean_games"),
    )
    median = exact_quantiles(per_player, "win_rate", {"m": 0.5}, hot_rows=hot_rows).select("m").scalar()
    return one.withColumn("median_rate", median)


def sustainability_score(df: DataFrame, time: str, break_even: float = BREAK_EVEN_RATE) -> DataFrame:
    """Five factors of 20 points each: significance, sample size, stability, interval, consistency.

    Fixed values: the thresholds and points below.
    """
    sig = significance(df, break_even=break_even, t_test=False).select("n", "win_rate", "p_binomial", "ci90_low", "ci95_low")
    days = daily_totals(df, time)
    thirds = period_thirds(days)
    trend = thirds.agg(
        (
            F.max(F.when(F.col("period") == "late", F.col("win_rate")))
            - F.max(F.when(F.col("period") == "early", F.col("win_rate")))
        ).alias("t")
    ).scalar()
    share = rolling_rate(days).agg(
        F.avg((F.col("rolling_win_rate") > break_even).cast("double")).alias("s")
    ).scalar()
    base = sig.withColumns({"win_rate_trend": trend, "share_above": share})

    def points(*steps: tuple[Column, int], last: int) -> Column:
        case = F.when(steps[0][0], steps[0][1])
        for cond, p in steps[1:]:
            case = case.when(cond, p)
        return case.otherwise(last)

    p, n, t = F.col("p_binomial"), F.col("n"), F.abs(F.coalesce("win_rate_trend", F.lit(0.0)))
    s, lo95, lo90 = F.col("share_above"), F.col("ci95_low"), F.col("ci90_low")
    factors = {
        "significance_points": points((p < 0.001, 20), (p < 0.01, 15), (p < 0.05, 10), last=0),
        "sample_points": points((n >= 5000, 20), (n >= 3000, 15), (n >= 1000, 10), last=5),
        "stability_points": points((t < 0.03, 20), (t < 0.05, 15), (t < 0.10, 10), last=5),
        "interval_points": points(
            (lo95 > break_even + 0.05, 20), (lo95 > break_even, 15), (lo90 > break_even, 10), last=5
        ),
        "consistency_points": points(
            (s.isNull(), 10), (s > 0.85, 20), (s > 0.75, 15), (s > 0.60, 10), last=5
        ),
    }
    out = base.withColumns(factors)
    out = out.withColumn("score", reduce(lambda a, b: a + b, [F.col(f) for f in factors]))
    rating = points(
        (F.col("score") >= 85, "EXCELLENT"), (F.col("score") >= 70, "GOOD"), (F.col("score") >= 55, "FAIR"),
        (F.col("score") >= 40, "QUESTIONABLE"), last="POOR",
    )
    return out.withColumn("rating", rating)


def sustainability_flags(score: DataFrame, break_even: float = BREAK_EVEN_RATE) -> DataFrame:
    """One row (check, level, value) per check of a `sustainability_score` row; level is red, warning or good.

    Fixed values: the limits below. The consistency check is absent where there are no rolling windows.
    """
    n, rate = F.col("n"), F.col("win_rate")
    trend = F.abs(F.coalesce("win_rate_trend", F.lit(0.0)))
    level = lambda red, warning: F.when(red, "red").when(warning, "warning").otherwise("good")
    checks = {
        "win_rate": (level(rate > 0.85, rate > 0.75), rate),
        "sample_size": (level(n < 1000, n < 3000), n.cast("double")),
        "stability": (level(trend > 0.10, trend > 0.05), trend),
        "interval": (level(F.col("ci95_low") < break_even, F.col("ci90_low") < break_even), F.col("ci95_low")),
        "consistency": (level(F.col("share_above") < 0.60, F.col("share_above") < 0.75), F.col("share_above")),
    }
    rows = [F.struct(F.lit(k).alias("check"), lv.alias("level"), v.alias("value")) for k, (lv, v) in checks.items()]
    return score.select(F.inline(F.array(*rows))).filter((F.col("check") != "consistency") | F.col("value").isNotNull())


def edge_bins(df: DataFrame, edge: str, win: str, bins: int = 5, quantiles: bool = True,
              hot_rows: int | None = 1_000_000) -> DataFrame:
    """Mean edge, rows and win rate per bin (right-closed quantile or equal-width), and whether rates only rise."""
    held = df.filter(F.col(edge).isNotNull())
    e = F.col(edge)
    if quantiles:
        probs = {f"b{i}": i / bins for i in range(bins + 1)}
        q = exact_quantiles(held, edge, probs, hot_rows=hot_rows)
        bounds = q.select(F.array_sort(F.array_distinct(F.array(*probs))).alias("b")).scalar()
        rows = held.withColumn("__b", bounds)
        # Duplicate bounds merge; the first bin also holds its lower bound.
        b = F.greatest(F.size(F.filter("__b", lambda x: x < e)) - 1, F.lit(0))
    else:
        lim = held.agg(F.struct(F.min(e).alias("lo"), F.max(e).alias("hi")).alias("m")).scalar()
        rows = held.withColumn("__b", lim)
        b = equal_width_bin(e, F.col("__b.lo"), F.col("__b.hi"), bins)
    per = rows.withColumn("bin", b.cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_edge"), F.avg(F.col(win).cast("double")).alias("win_rate")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    rising = F.coalesce(F.col("win_rate") >= F.lag("win_rate").over(w), F.lit(True))
    marked = per.withColumn("__up", rising)
    return marked.withColumn("is_monotonic", F.bool_and("__up").over(Window.partitionBy(F.lit(0)))).drop("__up")


def bet_distribution(df: DataFrame, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Counts per side and the distribution of edge, stake and confidence over the bets made."""
    over = F.col("should_bet_over")
    bets = df.filter(over | F.col("should_bet_under")).withColumns(
        {
            "__edge": F.when(over, F.col("edge_over")).otherwise(F.col("edge_under")),
            "__size": F.when(over, F.col("bet_size_over")).otherwise(F.col("bet_size_under")),
        }
    )
    one = bets.agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.count_if("should_bet_over").alias("n_over"),
        F.count_if("should_bet_under").alias("n_under"),
        F.avg("__edge").alias("avg_edge"),
        F.min("__edge").alias("min_edge"),
        F.max("__edge").alias("max_edge"),
        F.avg("__size").alias("avg_bet_size"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg("cv").alias("avg_cv"),
    )
    edge_med = exact_quantiles(bets, "__edge", {"m": 0.5}, hot_rows=hot_rows).select("m").scalar()
    size_med = exact_quantiles(bets, "__size", {"m": 0.5}, hot_rows=hot_rows).select("m").scalar()
    return one.withColumns({"median_edge": edge_med, "median_bet_size": size_med})


def strategy_compare(df: DataFrame, actual: str, line: str, win: float = WIN_PROFIT, loss: float = LOSS_PROFIT) -> DataFrame:
    """Point decisions against probability decisions on the same rows with a line."""
    over = F.col("should_bet_over")
    made = over | F.col("should_bet_under")
    right = F.when(over, F.col(actual) > F.col(line)).otherwise(F.col(actual) <= F.col(line))
    prob_profit = F.when(right, F.lit(win)).otherwise(F.lit(loss))
    return df.filter("has_line").agg(
        F.count(F.lit(1)).alias("original_n_bets"),
        F.avg(F.col("bet_correct").cast("double")).alias("original_win_rate"),
        (F.avg("profit") * 100).alias("original_roi"),
        F.count_if(made).alias("prob_n_bets"),
        F.avg(F.when(made, right.cast("double"))).alias("prob_win_rate"),
        (F.avg(F.when(made, prob_profit)) * 100).alias("prob_roi"),
    )


def variance_quality(df: DataFrame, actual: str, mean: str, variance: str) -> DataFrame:
    """How well the predicted variance tracks the squared error, and Gaussian interval coverage."""
    e = F.col(actual) - F.col(mean)
    sd = F.sqrt(F.col(variance))
    held = df.filter(e.isNotNull() & F.col(variance).isNotNull())
    return held.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(F.col(variance), e * e).alias("variance_corr"),
        (F.avg(variance) / F.nullif(F.avg(e * e), F.lit(0.0))).alias("variance_ratio"),
        F.avg((F.abs(e) <= sd).cast("double")).alias("coverage_68"),
        F.avg((F.abs(e) <= 1.96 * sd).cast("double")).alias("coverage_95"),
    )


def equity_curve(df: DataFrame, keys: Keys, stake: str, won: Column, odds=O.DEFAULT_ODDS, bankroll: float = 1000.0) -> DataFrame:
    """Bankroll after every bet when each bet stakes a share of it.

    Compounding is a running sum of logs; a stake share below one keeps every factor positive.
    """
    step = F.log1p(F.col(stake) * F.when(won, O.payoff(odds)).otherwise(F.lit(-1.0)))
    out = on_timeline(df, keys, lambda t: t.running({"__log": Running("sum", step, prior=False)}))
    return out.withColumn("bankroll", bankroll * F.exp("__log")).drop("__log")


def equity_summary(curve: DataFrame, by, time: str, tie, bankroll: float = 1000.0) -> DataFrame:
    """Final, highest and lowest bankroll and the fall below the start, per strategy."""
    last = F.max_by("bankroll", F.struct(F.col(time), *[F.col(t) for t in tie]))
    one = curve.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_bets"),
        last.alias("final_bankroll"),
        F.greatest(F.max("bankroll"), F.lit(bankroll)).alias("max_bankroll"),
        F.least(F.min("bankroll"), F.lit(bankroll)).alias("min_bankroll"),
    )
    return one.withColumns(
        {
            "roi": (F.col("final_bankroll") - bankroll) / bankroll * 100,
            "max_drawdown": bankroll - F.col("min_bankroll"),
        }
    )
